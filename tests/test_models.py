import numpy as np
import pytest

from tidemark.operators import models as M


def data(n=120, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 6, 6)) + y[:, None, None]
    return x, y


@pytest.mark.parametrize("recipe", [M.dense_recipe([8]), M.cnn_recipe([3], [6]), M.residual_recipe([[1, 1], [1]], 2), M.dense_block_recipe([2], 2), M.inception_recipe(1, 2)])
def test_topologies_score_and_learn(recipe):
    x, y = data()
    net = M.Network(recipe, (6, 6))
    p = net(x)
    assert p.shape == (120, 2) and np.allclose(p.sum(1), 1)
    optimizer = M.Optimizer("Adam", 0.01)
    losses = [net.train_step(x, y, optimizer) for _ in range(40)]
    assert losses[-1] < losses[0]


def test_optimizers_take_their_own_steps():
    """First steps by hand for the gradient 0.5 at rate 0.1, and three more rules over two steps."""
    g = np.array([0.5])
    step = lambda name, **p: (o := M.Optimizer(name, 0.1, **p), o.begin(), float(o.step("w", g)[0]))[2]
    want = {"SGD": -0.05, "Adagrad": -0.1 * 0.5 / np.sqrt(0.35), "RMSprop": -0.1 * 0.5 / np.sqrt(0.025), "Adadelta": -0.1 * np.sqrt(1e-7) / np.sqrt(0.0125) * 0.5, "Adam": -0.1, "Adamax": -0.1, "Nadam": -0.1 * (0.9 * 0.05 / 0.19 + 0.5) / 0.5}
    assert {k: step(k) for k in want} == pytest.approx(want, rel=1e-4) and set(want) == set(M.OPTIMIZERS)
    for momentum, nesterov, second in ((0.9, False, -0.095), (0.9, True, -0.1355)):
        o = M.Optimizer("SGD", 0.1, momentum=momentum, nesterov=nesterov)
        moves = [(o.begin(), float(o.step("w", g)[0]))[1] for _ in range(2)]
        assert moves[1] == pytest.approx(second)
    rates = M.schedule("ExponentialDecay", 1.0, decay_steps=10, decay_rate=0.5, staircase=True)
    assert [rates(n) for n in (0, 9, 10, 25)] == [1.0, 1.0, 0.5, 0.25]
    assert M.schedule("PiecewiseConstantDecay", 0, boundaries=[5], values=[1.0, 0.1])(5) == 1.0 and M.schedule("PolynomialDecay", 1.0, decay_steps=10, end_learning_rate=0.0)(5) == 0.5
    assert M.schedule("InverseTimeDecay", 1.0, decay_steps=2, decay_rate=1.0)(4) == pytest.approx(1 / 3)
    with pytest.raises(ValueError, match="schedule"):
        M.schedule("Never", 1.0)


ALL_LAYERS = [M.dense_recipe([5], 3), M.cnn_recipe([3, 2], [4], 3), M.cnn_recipe([2], [3], 3, kernel=2), M.residual_recipe([[1, 1], [1]], 2, 3), M.dense_block_recipe([2], 2, 3), M.inception_recipe(1, 2, 3), M.Recipe([{"kind": "dropout", "rate": 0.0}, *M.dense_recipe([5]).layers], 3)]


@pytest.mark.parametrize(("recipe", "loss"), [(r, M.TRAINABLE[0]) for r in ALL_LAYERS] + [(ALL_LAYERS[1], x) for x in M.TRAINABLE[1:]])
def test_gradients_by_differences(recipe, loss):
    """All arrays of all kinds of layers."""
    x, y = data(10)
    net = M.Network(recipe, (6, 6), seed=2)
    value, sums = net.gradients(x, y, loss)
    assert set(sums) == set(net.weights)
    for key, g in sums.items():
        at = tuple(int(n) // 2 for n in g.shape)
        w = net.weights[key]
        kept, ends = w[at], []
        for d in (1e-5, -1e-5):
            w[at] = kept + d
            ends.append(net.gradients(x, y, loss)[0])
        w[at] = kept
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-5)
    with pytest.raises(ValueError, match="minimises"):
        net.gradients(x, y, "Hinge")


def test_recipes_train_as_they_say(spark):
    """Data-parallel steps are those on the whole batch, and another optimizer or rate gives other weights."""
    x, y = data(40)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "data array<array<double>>, label int").repartition(3)
    layers = M.dense_recipe([4]).layers
    ends = []
    for name, rate in (("SGD", 0.1), ("SGD", {"recipe_name": "ExponentialDecay", "parameters": {"initial_learning_rate": 0.1, "decay_steps": 1, "decay_rate": 0.1}}), ("Adam", 0.1)):
        recipe = M.Recipe(layers, optimizer={"recipe_name": name, "parameters": {"learning_rate": rate}})
        net, alone = M.Network(recipe, (6, 6), seed=5), M.Network(recipe, (6, 6), seed=5)
        history = M.train(net, df, 2)
        optimizer = alone.optimizer()
        losses = [alone.train_step(x, y, optimizer) for _ in range(2)]
        assert [r["train_loss"] for r in history] == pytest.approx(losses)
        assert all(np.allclose(net.weights[k], alone.weights[k]) for k in net.weights)
        ends.append(net.weights["top.w"])
    assert not np.allclose(ends[0], ends[1]) and not np.allclose(ends[0], ends[2])


def test_save_load_new_top_and_early_stop(spark, tmp_path):
    x, y = data(40)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "data array<array<double>>, label int")
    net = M.Network(M.cnn_recipe([2], [4], dims=2), (6, 6))
    net.save(str(tmp_path / "m.zip"), {"rate": "1000 Hz"}, {"made": "here"})
    again, representation = M.Network.load(str(tmp_path / "m.zip"))
    assert np.allclose(net(x), again(x)) and representation == {"rate": "1000 Hz"}
    other, _ = M.Network.load(str(tmp_path / "m.zip"), new_classes=3)
    before = {k: v.copy() for k, v in other.weights.items()}
    other.train_step(x, y, other.optimizer())
    assert other(x).shape == (40, 3) and all(np.array_equal(before[k], v) for k, v in other.weights.items() if not k.startswith("top."))
    net.recipe.optimizer.update({"recipe_name": "SGD", "parameters": {"learning_rate": 0.0}})
    stopped = M.train(net, df, 50, validate=df, patience=2, log=str(tmp_path / "log.csv"))
    assert len(stopped) == 4 and (tmp_path / "log.csv").exists()
    net.recipe.write(str(tmp_path / "r.json"))
    assert M.Recipe.read(str(tmp_path / "r.json")) == net.recipe
    with pytest.raises(ValueError, match="optimizer"):
        M.Recipe([], optimizer={"recipe_name": "None", "parameters": {}})
    with pytest.raises(ValueError, match="dimensional"):
        net(np.zeros((2, 3)))


def test_scoring_and_evaluation(spark):
    x, y = data(40)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "data array<array<double>>, label int")
    net = M.Network(M.Recipe(M.dense_recipe([8]).layers, optimizer={"recipe_name": "Adam", "parameters": {"learning_rate": 0.05}}), (6, 6))
    M.train(net, df, 8, batches=2)
    recipe = M.Recipe([], metrics=[{"recipe_name": k, "parameters": {}} for k in ("CategoricalAccuracy", "Precision", "MeanSquaredError")])
    got = M.evaluate(M.score(df, net), recipe=recipe).first()
    p = net(x)
    assert got["CategoricalAccuracy"] == got["accuracy"] and got["MeanSquaredError"] == pytest.approx(float(((p[:, 1] - y) ** 2).mean()))
    assert got["n"] == 40 and got["accuracy"] == pytest.approx(float((net(x).argmax(1) == y).mean())) and got["accuracy"] > 0.8
