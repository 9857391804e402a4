"""Scoring and training of models over tables: recipes, a small network, batch scoring, evaluation.

A recipe is a JSON document that names the model, its layers, optimiser, loss and metrics. Networks are
plain NumPy stacks of layers, enough to score and to train modest detectors here; any callable of a
batch of arrays to a batch of score vectors can be scored instead.

Training is data-parallel: in each round every task sums the gradients of its rows at the present
weights, Spark sums the tasks' vectors, and the driver, which sees model-sized sums only, takes the
optimiser's step.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics

#: Losses that training minimises, for class labels; a recipe with another one can be scored and not trained.
TRAINABLE = ("CategoricalCrossentropy", "SparseCategoricalCrossentropy", "MeanSquaredError")


class Optimizer:
    """One of the usual first-order rules, by name, with its usual parameters.

    ``step`` gives the change of an array for its gradient; ``rate`` may be a number, or a function of the
    number of steps so far (see ``schedule``). Moments are kept by the name of the array.
    """

    def __init__(self, name: str, learning_rate=None, rho: float | None = None, momentum: float = 0.0, nesterov: bool = False, beta_1: float = 0.9, beta_2: float = 0.999, epsilon: float = 1e-7, initial_accumulator_value: float = 0.1, decay: float = 0.0):
        if name not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {name!r}")
        self.name, self.momentum, self.nesterov, self.b1, self.b2, self.eps, self.decay = name, momentum, nesterov, beta_1, beta_2, epsilon, decay
        self.rho = rho if rho is not None else 0.95 if name == "Adadelta" else 0.9
        self.rate = learning_rate if learning_rate is not None else 0.01 if name == "SGD" else 0.001
        self.first, self.state, self.n = initial_accumulator_value, {}, 0

    def _moment(self, key: tuple, like: np.ndarray, start: float = 0.0) -> np.ndarray:
        return self.state.setdefault(key, np.full(like.shape, start))

    def begin(self) -> None:
        """Before the arrays of each step."""
        self.n += 1

    def step(self, key: str, g: np.ndarray) -> np.ndarray:
        rate = (self.rate(self.n - 1) if callable(self.rate) else self.rate) / (1 + self.decay * (self.n - 1))
        if self.name == "SGD":
            if not self.momentum:
                return -rate * g
            v = self._moment((key, "v"), g)
            v *= self.momentum
            v -= rate * g
            return self.momentum * v - rate * g if self.nesterov else v.copy()
        if self.name == "Adagrad":
            s = self._moment((key, "s"), g, self.first)
            s += g * g
            return -rate * g / (np.sqrt(s) + self.eps)
        if self.name in ("RMSprop", "Adadelta"):
            s = self._moment((key, "s"), g)
            s += (1 - self.rho) * (g * g - s)
            if self.name == "RMSprop":
                v = self._moment((key, "v"), g)
                v *= self.momentum
                v += rate * g / (np.sqrt(s) + self.eps)
                return -v
            d = self._moment((key, "d"), g)
            move = -np.sqrt(d + self.eps) / np.sqrt(s + self.eps) * g
            d += (1 - self.rho) * (move * move - d)
            return rate * move
        m, s = self._moment((key, "m"), g), self._moment((key, "s"), g)
        m += (1 - self.b1) * (g - m)
        unbiased = m / (1 - self.b1**self.n)
        if self.name == "Adamax":
            s[...] = np.maximum(self.b2 * s, np.abs(g))
            return -rate * unbiased / (s + self.eps)
        s += (1 - self.b2) * (g * g - s)
        if self.name == "Nadam":
            unbiased = self.b1 * m / (1 - self.b1 ** (self.n + 1)) + (1 - self.b1) * g / (1 - self.b1**self.n)
        return -rate * unbiased / (np.sqrt(s / (1 - self.b2**self.n)) + self.eps)


OPTIMIZERS = ("Adadelta", "Adagrad", "Adam", "Adamax", "Nadam", "RMSprop", "SGD")


def schedule(kind: str, rate: float, **p) -> Callable[[int], float]:
    """A learning rate as a function of the steps so far: ExponentialDecay, InverseTimeDecay, PiecewiseConstantDecay, PolynomialDecay."""
    if kind == "PiecewiseConstantDecay":
        return lambda n: p["values"][int(np.searchsorted(p["boundaries"], n, side="left"))]
    part = (lambda n: n // p["decay_steps"]) if p.get("staircase") else (lambda n: n / p["decay_steps"])
    if kind == "ExponentialDecay":
        return lambda n: rate * p["decay_rate"] ** part(n)
    if kind == "InverseTimeDecay":
        return lambda n: rate / (1 + p["decay_rate"] * part(n))
    if kind == "PolynomialDecay":
        low, steps, power, again = p.get("end_learning_rate", 1e-4), p["decay_steps"], p.get("power", 1.0), p.get("cycle", False)

        def at(n: int) -> float:
            whole = steps * max(1, -(-n // steps)) if again else steps
            return (rate - low) * (1 - min(n, whole) / whole) ** power + low

        return at
    raise ValueError(f"unknown schedule {kind!r}")


@dataclass(frozen=True)
class Recipe:
    """What a model is made of; ``layers`` are dictionaries with a ``kind`` and its parameters."""

    layers: list[dict]
    n_classes: int = 2
    interface: str = "Network"
    optimizer: dict = field(default_factory=lambda: {"recipe_name": "Adam", "parameters": {"learning_rate": 0.005}})
    loss_function: dict = field(default_factory=lambda: {"recipe_name": "CategoricalCrossentropy", "parameters": {}})
    metrics: list[dict] = field(default_factory=lambda: [{"recipe_name": "CategoricalAccuracy", "parameters": {}}])

    def __post_init__(self):
        if self.optimizer["recipe_name"] not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {self.optimizer['recipe_name']!r}")
        for m in [self.loss_function, *self.metrics]:
            if m["recipe_name"] not in metrics.REGISTRY:
                raise ValueError(f"unknown metric or loss {m['recipe_name']!r}")

    @classmethod
    def read(cls, path: str) -> Recipe:
        return cls(**json.loads(Path(path).read_text()))

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))


def dense_recipe(hidden: list[int], n_classes: int = 2) -> Recipe:
    return Recipe([{"kind": "flatten"}, *[{"kind": "dense", "units": n, "activation": "relu"} for n in hidden]], n_classes)


def cnn_recipe(filters: list[int], hidden: list[int], n_classes: int = 2, kernel: int = 3, dims: int = 2) -> Recipe:
    conv = [x for n in filters for x in ({"kind": f"conv{dims}d", "filters": n, "kernel": kernel, "activation": "relu"}, {"kind": f"pool{dims}d", "size": 2})]
    return Recipe([*conv, {"kind": "flatten"}, *[{"kind": "dense", "units": n, "activation": "relu"} for n in hidden]], n_classes)


def residual_recipe(blocks: list[list[int]], filters: int = 16, n_classes: int = 2, kernel: int = 3) -> Recipe:
    """Residual blocks: each entry of ``blocks`` is a set, whose later members keep the shape."""
    layers: list[dict] = [{"kind": "conv2d", "filters": filters, "kernel": kernel, "activation": "relu"}]
    for i, members in enumerate(blocks):
        layers += [{"kind": "residual", "filters": filters * 2**i, "kernel": kernel} for _ in members]
    return Recipe([*layers, {"kind": "global_mean"}], n_classes)


def dense_block_recipe(blocks: list[int], growth: int = 4, n_classes: int = 2) -> Recipe:
    """Blocks whose layers see all earlier outputs of the block, with pooling in between."""
    layers = [x for n in blocks for x in (*[{"kind": "concat_conv", "filters": growth, "kernel": 3}] * n, {"kind": "pool2d", "size": 2})]
    return Recipe([*layers, {"kind": "global_mean"}], n_classes)


def inception_recipe(n_blocks: int, filters: int = 8, n_classes: int = 2) -> Recipe:
    layers = [x for _ in range(n_blocks) for x in ({"kind": "branches", "filters": filters, "kernels": [1, 3, 5]}, {"kind": "pool2d", "size": 2})]
    return Recipe([*layers, {"kind": "global_mean"}], n_classes)


def _windows(x: np.ndarray, kernel: tuple[int, ...], flipped: bool = False) -> np.ndarray:
    """(n, *places, channels, *kernel) windows of a same-size convolution over all axes but first and last."""
    dims = len(kernel)
    pads = [((k - 1) // 2, k // 2)[:: -1 if flipped else 1] for k in kernel]
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, [(0, 0), *pads, (0, 0)]), kernel, axis=tuple(range(1, dims + 1)))


def _conv(x: np.ndarray, w: np.ndarray, flipped: bool = False) -> np.ndarray:
    """Same-size convolution; w is (*kernel, in, out)."""
    dims = x.ndim - 2
    return np.tensordot(_windows(x, w.shape[:dims], flipped), w, axes=([*range(x.ndim, x.ndim + dims), x.ndim - 1], [*range(dims), dims]))


def _conv_back(x: np.ndarray, w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the input and by the weights."""
    dims = x.ndim - 2
    by_weight = np.tensordot(_windows(x, w.shape[:dims]), g, axes=([*range(dims + 1)], [*range(dims + 1)]))
    turned = np.flip(w, tuple(range(dims))).swapaxes(-1, -2)
    return _conv(g, turned, flipped=True), np.moveaxis(by_weight, 0, dims)


def _pool(x: np.ndarray, size: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Maxima over blocks, what is left over at the ends cut off, and the way back to the maxima's places."""
    places = [s // size or 1 for s in x.shape[1:-1]]
    sizes = [size if s >= size else s for s in x.shape[1:-1]]
    inside = (slice(None), *[slice(0, a * b) for a, b in zip(places, sizes, strict=True)], slice(None))
    split = [x.shape[0], *[v for ab in zip(places, sizes, strict=True) for v in ab], x.shape[-1]]
    axes = tuple(2 + 2 * i for i in range(len(places)))
    blocks = x[inside].reshape(split)
    top = blocks.max(axes, keepdims=True)

    def back(g: np.ndarray) -> np.ndarray:
        hit = blocks == top
        out = np.zeros_like(x)
        out[inside] = (hit / hit.sum(axes, keepdims=True) * g.reshape(top.shape)).reshape(x[inside].shape)
        return out

    return top.reshape(x.shape[0], *places, x.shape[-1]), back


class Network:
    """A stack of layers with a softmax top.

    Each layer gives its output and a function from the gradient by its output to that by its input and those by
    its arrays, so all of them can be trained; arrays of layers named in ``frozen`` stay as they are.
    """

    def __init__(self, recipe: Recipe, input_shape: tuple[int, ...], seed: int = 1, weights: dict[str, np.ndarray] | None = None):
        self.recipe, self.input_shape, self.rng = recipe, tuple(input_shape), np.random.default_rng(seed)
        self.weights = dict(weights or {})
        self.frozen: set[str] = set()
        if not weights:
            self(np.zeros((1, *input_shape)))

    def _get(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.weights:
            fan = int(np.prod(shape[:-1])) or 1
            self.weights[name] = self.rng.normal(0, np.sqrt(2 / fan), shape) if len(shape) > 1 else np.zeros(shape)
        return self.weights[name]

    def _convolved(self, x: np.ndarray, name: str, kernel: int, filters: int, bias: str | None = None):
        w = self._get(name, *[kernel] * (x.ndim - 2), x.shape[-1], filters)
        b = self._get(bias, filters) if bias else 0.0

        def back(g):
            gx, gw = _conv_back(x, w, g)
            return gx, {name: gw} | ({bias: g.sum(tuple(range(g.ndim - 1)))} if bias else {})

        return _conv(x, w) + b, back

    def _layer(self, i: int, spec: dict, x: np.ndarray, training: bool = False):
        kind = spec["kind"]
        if kind in ("conv1d", "conv2d", "concat_conv"):
            z, back = self._convolved(x, f"{i}.w", spec["kernel"], spec["filters"], f"{i}.b")
            y = np.maximum(z, 0)
            if kind != "concat_conv":
                return y, lambda g: back(g * (z > 0))

            def joined(g):
                gx, found = back(g[..., x.shape[-1] :] * (z > 0))
                return gx + g[..., : x.shape[-1]], found

            return np.concatenate([x, y], -1), joined
        if kind == "residual":
            z, first = self._convolved(x, f"{i}.w", spec["kernel"], spec["filters"], f"{i}.b")
            y, second = self._convolved(np.maximum(z, 0), f"{i}.w2", spec["kernel"], spec["filters"])
            short, third = (x, lambda g: (g, {})) if x.shape[-1] == spec["filters"] else self._convolved(x, f"{i}.ws", 1, spec["filters"])
            out = short + y

            def summed(g):
                g = g * (out > 0)
                inner, two = second(g)
                gx, one = first(inner * (z > 0))
                side, three = third(g)
                return gx + side, one | two | three

            return np.maximum(out, 0), summed
        if kind == "branches":
            made = [self._convolved(x, f"{i}.w{k}", k, spec["filters"]) for k in spec["kernels"]]

            def forked(g):
                parts = [back(part * (z > 0)) for (z, back), part in zip(made, np.split(g, len(made), -1), strict=True)]
                return sum(gx for gx, _ in parts), {k: v for _, found in parts for k, v in found.items()}

            return np.concatenate([np.maximum(z, 0) for z, _ in made], -1), forked
        if kind in ("pool1d", "pool2d"):
            y, back = _pool(x, spec["size"])
            return y, lambda g: (back(g), {})
        if kind == "dropout":
            keep = (self.rng.random(x.shape) >= spec["rate"]) / (1 - spec["rate"]) if training else 1.0
            return x * keep, lambda g: (g * keep, {})
        if kind == "flatten":
            return x.reshape(len(x), -1), lambda g: (g.reshape(x.shape), {})
        if kind == "global_mean":
            axes = tuple(range(1, x.ndim - 1))
            return x.mean(axis=axes), lambda g: (np.broadcast_to(np.expand_dims(g, axes), x.shape) / np.prod([x.shape[k] for k in axes]), {})
        if kind == "dense":
            return self._dense_layer(str(i), x, spec["units"], spec.get("activation") == "relu")
        raise ValueError(f"unknown layer {kind!r}")

    def _dense_layer(self, name: str, x: np.ndarray, units: int, relu: bool):
        flat = x.reshape(len(x), -1)
        w, b = self._get(f"{name}.w", flat.shape[-1], units), self._get(f"{name}.b", units)
        z = flat @ w + b

        def back(g):
            g = g * (z > 0) if relu else g
            return (g @ w.T).reshape(x.shape), {f"{name}.w": flat.T @ g, f"{name}.b": g.sum(0)}

        return np.maximum(z, 0) if relu else z, back

    def _layers(self) -> list[str]:
        return [*map(str, range(len(self.recipe.layers))), "top"]

    def _forward(self, x: np.ndarray, training: bool = False) -> tuple[np.ndarray, list[Callable]]:
        """Probabilities, and the ways back through the layers."""
        backs = []
        for i, spec in enumerate(self.recipe.layers):
            x, back = self._layer(i, spec, x, training)
            backs.append(back)
        z, back = self._dense_layer("top", x, self.recipe.n_classes, False)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), [*backs, back]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(n, classes) probabilities for (n, *input_shape), or with a channel axis at the end."""
        return self._forward(self.with_channel(x))[0]

    def with_channel(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if x.ndim == len(self.input_shape) + 1:
            return x[..., None]
        if x.ndim != len(self.input_shape) + 2:
            raise ValueError(f"a batch of {x.ndim - 1}-dimensional inputs; expected {len(self.input_shape)}")
        return x

    def freeze(self, *names: str) -> None:
        self.frozen |= set(names)

    def unfreeze(self, *names: str) -> None:
        self.frozen -= set(names)

    def with_new_top(self, n_classes: int, freeze_base: bool = True) -> Network:
        kept = {k: v for k, v in self.weights.items() if not k.startswith("top.")}
        recipe = Recipe(**{**asdict(self.recipe), "n_classes": n_classes})
        new = Network(recipe, self.input_shape, weights=kept)
        new(np.zeros((1, *self.input_shape)))
        if freeze_base:
            new.freeze(*self._layers()[:-1])
        return new

    def gradients(self, x: np.ndarray, y: np.ndarray, loss: str = "CategoricalCrossentropy") -> tuple[float, dict[str, np.ndarray]]:
        """The summed loss of a batch and the sums of its gradients by the arrays of the layers that aren't frozen."""
        p, backs = self._forward(self.with_channel(x), training=True)
        hot = np.eye(self.recipe.n_classes)[np.asarray(y, int)]
        if loss == "MeanSquaredError":
            value = float(((p - hot) ** 2).mean(1).sum())
            d = 2 * (p - hot) / p.shape[1]
            g = p * (d - (d * p).sum(1, keepdims=True))
        elif loss in TRAINABLE:
            value = float(-np.log(np.maximum((p * hot).sum(1), 1e-12)).sum())
            g = p - hot
        else:
            raise ValueError(f"{loss} is not a loss that training minimises; it is one of {TRAINABLE}")
        sums: dict[str, np.ndarray] = {}
        for name, back in zip(self._layers()[::-1], backs[::-1], strict=True):
            g, found = back(g)
            if name not in self.frozen:
                sums |= found
        return value, sums

    def optimizer(self) -> Optimizer:
        """The recipe's optimizer; its learning rate may be a schedule {"recipe_name", "parameters"}."""
        p = dict(self.recipe.optimizer.get("parameters") or {})
        rate = p.get("learning_rate")
        if isinstance(rate, dict):
            given = dict(rate["parameters"])
            p["learning_rate"] = schedule(rate["recipe_name"], given.pop("initial_learning_rate", 0.0), **given)
        return Optimizer(self.recipe.optimizer["recipe_name"], **p)

    def apply(self, optimizer: Optimizer, sums: dict[str, np.ndarray], n: int) -> None:
        """One step of the optimizer along mean gradients."""
        optimizer.begin()
        for key, g in sums.items():
            self.weights[key] = self.weights[key] + optimizer.step(key, g / n)

    def train_step(self, x: np.ndarray, y: np.ndarray, optimizer: Optimizer) -> float:
        """One step on a batch at hand; returns the mean loss before it."""
        loss, sums = self.gradients(x, y, self.recipe.loss_function["recipe_name"])
        self.apply(optimizer, sums, len(x))
        return loss / len(x)

    def save(self, path: str, representation: dict | None = None, metadata: dict | None = None) -> None:
        """A zip archive: recipe, weights, and the representation and metadata if given."""
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("recipe.json", json.dumps({**asdict(self.recipe), "input_shape": self.input_shape}))
            buffer = io.BytesIO()
            np.savez(buffer, **self.weights)
            z.writestr("weights.npz", buffer.getvalue())
            for name, content in (("representation.json", representation), ("metadata.json", metadata)):
                if content is not None:
                    z.writestr(name, json.dumps(content))

    @classmethod
    def load(cls, path: str, new_classes: int | None = None) -> tuple[Network, dict | None]:
        """The network and its representation; with ``new_classes`` a new top on a frozen base."""
        with zipfile.ZipFile(path) as z:
            recipe = json.loads(z.read("recipe.json"))
            shape = tuple(recipe.pop("input_shape"))
            arrays = np.load(io.BytesIO(z.read("weights.npz")))
            model = cls(Recipe(**recipe), shape, weights={k: arrays[k] for k in arrays.files})
            representation = json.loads(z.read("representation.json")) if "representation.json" in z.namelist() else None
        return (model.with_new_top(new_classes) if new_classes else model), representation


def _stacked(values) -> np.ndarray:
    return np.stack([np.vstack(v) if len(v) and np.ndim(v[0]) else np.asarray(v, float) for v in values])


def summed_gradients(df: DataFrame, model: Network, data: str = "data", label: str = "label", batch: int = 128) -> tuple[int, float, dict[str, np.ndarray]]:
    """(rows, summed loss, summed gradients by array) over all rows: one vector leaves each task, and Spark adds them up."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    loss = model.recipe.loss_function["recipe_name"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, n, total, sums = shared.value, 0, 0.0, {}
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                value, found = net.gradients(_stacked(part[data]), part[label].to_numpy(), loss)
                n, total = n + len(part), total + value
                for k, g in found.items():
                    sums[k] = sums.get(k, 0) + g
        if n:
            yield pd.DataFrame({"key": ["", *sums], "at": [[float(n), total], *(g.ravel().tolist() for g in sums.values())]})

    parts = df.select(data, label).mapInPandas(run, "key string, at array<double>")
    added = parts.select("key", F.posexplode("at").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
    rows = added.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("at")).collect()
    shared.unpersist()
    by = {r["key"]: np.array(r["at"]) for r in rows}
    n, total = by.pop("", np.zeros(2))
    return int(n), float(total), {k: v.reshape(model.weights[k].shape) for k, v in by.items()}


def train(model: Network, df: DataFrame, epochs: int = 5, batches: int = 1, data: str = "data", label: str = "label", validate: DataFrame | None = None, patience: int | None = None, log: str | None = None, seed: int = 1) -> list[dict]:
    """Epochs of the recipe's optimizer over a table, in ``batches`` parts of it that a hash draws anew each epoch.

    Stops early when the validation loss no longer falls. Returns, and writes as CSV to ``log``, a row for each epoch.
    """
    optimizer = model.optimizer()
    history, best, since = [], float("inf"), 0
    for epoch in range(epochs):
        seen, lost = 0, 0.0
        for k in range(batches):
            part = df.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), data, label), F.lit(batches)) == k) if batches > 1 else df
            n, loss, sums = summed_gradients(part, model, data, label)
            if n:
                model.apply(optimizer, sums, n)
            seen, lost = seen + n, lost + loss
        row = {"epoch": epoch, "train_loss": lost / max(1, seen)}
        if validate is not None:
            got = evaluate(score(validate, model, data), label).first()
            row |= {"val_loss": float(got["loss"]), "val_accuracy": float(got["accuracy"])}
            since = 0 if row["val_loss"] < best - 1e-4 else since + 1
            best = min(best, row["val_loss"])
        history.append(row)
        if patience is not None and since > patience:
            break
    if log:
        pd.DataFrame(history).to_csv(log, index=False)
    return history


def score(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], data: str = "data", out: str = "scores", batch: int = 128) -> DataFrame:
    """Rows with the model's score vector. The model goes to each executor once, as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = shared.value
        for values in columns:
            made = []
            for i in range(0, len(values), batch):
                part = values.iloc[i : i + batch]
                made += np.asarray(fn(_stacked(part))).tolist()
            yield pd.Series(made)

    return df.withColumn(out, run(data))


#: Metrics of a recipe that are computed from a label and a score vector, and how.
ON_SCORES = ("CategoricalCrossentropy", "SparseCategoricalCrossentropy", "CategoricalHinge", "TopKCategoricalAccuracy", "SparseTopKCategoricalAccuracy")
ON_CLASSES = ("CategoricalAccuracy", "SparseCategoricalAccuracy")


def metric_value(name: str, label: str = "label", scores: str = "scores", positive: int = 1) -> Column:
    """A registered metric of score vectors against integer labels; binary ones look at the class ``positive``."""
    fn = metrics.REGISTRY[name]
    if name in ON_SCORES:
        return fn(label, scores)
    if name in ON_CLASSES:
        return fn(F.col(label), F.array_position(scores, F.array_max(scores)) - 1)
    p = F.get(F.col(scores), F.lit(positive))
    return fn(p) if name in ("Mean", "Sum") else fn((F.col(label) == positive).cast("double"), p)


def evaluate(scored: DataFrame, label: str = "label", scores: str = "scores", recipe: Recipe | None = None) -> DataFrame:
    """Loss and accuracy of score vectors against integer labels, and the recipe's own loss and metrics if it is given."""
    predicted = F.array_position(scores, F.array_max(scores)) - 1
    own = [] if recipe is None else [metric_value(m["recipe_name"], label, scores).alias(m["recipe_name"]) for m in {m["recipe_name"]: m for m in (recipe.loss_function, *recipe.metrics)}.values()]
    return scored.agg(metrics.sparse_crossentropy(label, scores).alias("loss"), metrics.class_accuracy(F.col(label), predicted).alias("accuracy"), F.count("*").alias("n"), *own)


def detect(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], label: int = 1, data: str = "data", **options) -> DataFrame:
    """Detections of one class in a table of inputs (filename, offset, data); ``options`` are those of ``detections.detect``."""
    from tidemark.operators import detections

    frames = score(df, model, data).select("filename", "offset", F.get("scores", F.lit(label)).alias("score"))
    return detections.detect(frames, **options)
