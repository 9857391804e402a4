"""Named queries over signals and images: kernels, filters, spectra, networks, and the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import arrays, scalar
from tidemark.functions import kernels as K
from tidemark.operators import models as M
from tidemark.operators import representations as R
from tidemark.operators import signals as X
from tidemark.plans import views as V
from tidemark.plans.catalogue import DFT, MEL_BANK, query, rounded
from tidemark.plans.views import sql


def _image(data: str = "data"):
    """A signal of 64 samples as an image of 8 rows in time."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(data, t * 8 + 1, 8))


def _images(spark, d):
    return V.signals(spark, d).select(F.col("id").alias("filename"), _image().alias("data"))


def _long(df):
    return X.explode_image(df).withColumn("value", F.round("value", 6))


def _samples(spark, d, column):
    return V.signals(spark, d).select("id", F.posexplode(column).alias("pos", "x")).select("id", "pos", *rounded("x"))


# Signals -----------------------------------------------------------------------------------------


@query(sql("SELECT id, (pos - 10)::INT AS pos, round(x, 6) AS x FROM signal WHERE pos BETWEEN 10 AND 10 + label", "signal"))
def cropped_signals(spark, d):
    return _samples(spark, d, arrays.crop("data", F.lit(10), F.col("label") + 10))


@query(
    sql(
        """WITH j AS (SELECT a.id, unnest(range(0, 128)) AS i FROM signal a WHERE a.pos = 0),
t AS (SELECT id, i, CASE WHEN i < 61 THEN 0.0 WHEN i > 66 THEN 1.0 ELSE (i - 60) / 7.0 END AS t FROM j),
w AS (SELECT id, i, t * t * (3 - 2 * t) AS w, CASE WHEN i < 61 THEN i WHEN i < 64 THEN i WHEN i < 67 THEN 63 - (i - 64) ELSE 0 END AS a, CASE WHEN i < 61 THEN 0 WHEN i < 64 THEN 2 - (i - 61) ELSE i - 64 END AS b FROM t)
SELECT w.id, i::INT AS pos, round((1 - w) * x.x + w * y.x, 6) AS x FROM w JOIN signal x ON x.id = w.id AND x.pos = w.a JOIN signal y ON y.id = w.id AND y.pos = w.b""",
        "signal",
    )
)
def joined_signals(spark, d):
    return _samples(spark, d, arrays.join_smooth("data", "data", 6))


# Constants of a running mean that keeps 15 % of its start after 4 steps.
_EPS = 1 - math.exp(math.log(0.15) / 4.0)


@query(
    sql(
        f"""WITH m AS (SELECT *, avg(value) OVER (PARTITION BY filename, f_bin) AS m FROM image)
SELECT a.filename, a.t_bin, a.f_bin, round(a.value - (power({1 - _EPS}, a.t_bin) * a.m + {_EPS} * coalesce(sum(b.value * power({1 - _EPS}, a.t_bin - 1 - b.t_bin)), 0)), 6) AS value
FROM m a LEFT JOIN image b ON a.filename = b.filename AND a.f_bin = b.f_bin AND b.t_bin < a.t_bin GROUP BY a.filename, a.t_bin, a.f_bin, a.value, a.m""",
        "image",
    )
)
def running_tonal_noise(spark, d):
    return _long(X.reduce_tonal_running(_images(spark, d), 4.0))


_HALF = """f AS (SELECT id, k, sum(x * cos(2 * pi() * k * pos / 64)) AS re, -sum(x * sin(2 * pi() * k * pos / 64)) AS im FROM signal, (SELECT unnest(range(0, 17)) AS k) GROUP BY id, k)"""


@query(sql(f"WITH {_HALF} SELECT id, j::INT AS pos, round(sum(CASE WHEN k = 0 OR k = 16 THEN re * cos(2 * pi() * k * j / 32) ELSE 2 * (re * cos(2 * pi() * k * j / 32) - im * sin(2 * pi() * k * j / 32)) END) / 64, 6) AS x FROM f, (SELECT unnest(range(0, 32)) AS j) GROUP BY id, j", "signal"))
def resampled_signals(spark, d):
    return _samples(spark, d, K.kernel(lambda x: K.resample(x, 64.0, 32.0))("data"))


def _recursion(b, a, z) -> str:
    """SQL of a filter forward and backward over signals extended by odd reflection, one sample a step of a recursion."""
    n = len(a) - 1
    extra = 3 * (n + 1)
    last = 63 + 2 * extra

    def run(name: str, source: str) -> str:
        first = [f"x * {float(b[0])!r} + x * {float(z[0])!r}", *[f"x * {float(b[i])!r} + {f'x * {float(z[i])!r}' if i < n else '0'} - {float(a[i])!r} * (x * {float(b[0])!r} + x * {float(z[0])!r})" for i in range(1, n + 1)]]
        out = f"(s.x * {float(b[0])!r} + z1)"
        more = [out, *[f"s.x * {float(b[i])!r} + {f'z{i + 1}' if i < n else '0'} - {float(a[i])!r} * {out}" for i in range(1, n + 1)]]
        names = ["y", *[f"z{i}" for i in range(1, n + 1)]]
        return f"""{name} AS (SELECT id, i, {", ".join(f"{e} AS {m}" for e, m in zip(first, names, strict=True))} FROM {source} WHERE i = 0
UNION ALL SELECT s.id, s.i, {", ".join(more)} FROM {name} r JOIN {source} s ON s.id = r.id AND s.i = r.i + 1)"""

    ends = "ends AS (SELECT id, max(CASE WHEN pos = 0 THEN x END) AS head, max(CASE WHEN pos = 63 THEN x END) AS tail FROM signal GROUP BY id)"
    wide = f"""wide AS (SELECT id, pos + {extra} AS i, x FROM signal UNION ALL SELECT s.id, {extra} - pos, 2 * head - x FROM signal s JOIN ends USING (id) WHERE pos BETWEEN 1 AND {extra}
UNION ALL SELECT s.id, {extra} + 126 - pos, 2 * tail - x FROM signal s JOIN ends USING (id) WHERE pos BETWEEN {63 - extra} AND 62)"""
    return f"WITH RECURSIVE {V.SQL['signal']},\n{ends},\n{wide},\n{run('one', 'wide')},\nback AS (SELECT id, {last} - i AS i, y AS x FROM one),\n{run('two', 'back')}\nSELECT id, ({last} - i - {extra})::INT AS pos, round(y, 6) AS x FROM two WHERE {last} - i - {extra} BETWEEN 0 AND 63"


# The third-order Butterworth band-pass from 4 to 16 Hz at 64 samples a second, and its state after a long run of ones,
# worked out from the analogue polynomial (s^2 + w0^2) / (B s) in 1 / (s^3 + 2 s^2 + 2 s + 1) by the bilinear transform.
_BAND = (
    [0.08456652578282248, 0.0, -0.25369957734846743, 0.0, 0.25369957734846743, 0.0, -0.08456652578282248],
    [1.0, -2.4872553459257247, 2.917725887977626, -2.272974488546121, 1.314402467300694, -0.4622513488829758, 0.07320878558564828],
)
_BAND_SETTLED = [-0.08456652578282096, -0.08456652578282477, 0.1691330515656471, 0.16913305156564362, -0.08456652578282188, -0.08456652578282259]


@query(_recursion(*_BAND, _BAND_SETTLED))
def bandpass_filter(spark, d):
    return _samples(spark, d, K.kernel(lambda x: K.bandpass(x, 64.0, 4.0, 16.0), together=True)("data"))


# A resonator at 9 Hz and 64 samples a second, with the bandwidth 1.019 * 24.7 * (0.00437 * 9 + 1) and unit gain at its centre.
_RESONATOR = [0.9397051309350107, 0.0, 0.0], [1.0, -0.09728472312975582, 0.005879117628538991]
_RESONATOR_SETTLED = [0.09453538014957447, -0.006080421620866561]


@query(_recursion(*_RESONATOR, _RESONATOR_SETTLED))
def resonator_filter(spark, d):
    """One resonator of the gammatone bank, forward and backward."""
    section = K.gammatone_section(64.0, 9.0)[0]
    return _samples(spark, d, K.kernel(lambda x: K.zero_phase([section], x), together=True)("data"))


# Spectra -----------------------------------------------------------------------------------------


@query(
    sql(
        f"""WITH {DFT}, {MEL_BANK}, e AS (SELECT id, bank.m, 20 * log10(greatest(sum(dft.m * dft.m / 64 * w), 2.220446049250313e-16)) AS e FROM dft JOIN bank ON bank.k = dft.k GROUP BY id, bank.m)
SELECT id, q::INT - 1 AS q, round(sum(e * cos(pi() / 8 * q * (m + 0.5)) * sqrt(2.0 / 8)) * (1 + 10 * sin(pi() * (q - 1) / 20)), 4) AS c FROM e, (SELECT unnest(range(1, 6)) AS q) GROUP BY id, q""",
        "signal",
    )
)
def cepstra(spark, d):
    one = K.kernel(lambda x: K.mfcc(K.stft(x, 64, 64), 64, 64.0, 8, 5)[0])
    return V.signals(spark, d).select("id", F.posexplode(one("data")).alias("q", "c")).select("id", "q", F.round("c", 4).alias("c"))


@query(
    sql(
        """WITH b AS (SELECT unnest(range(0, 6)) AS b), f AS (SELECT b, 4 * power(2, b / 2.0) AS f FROM b), n AS (SELECT b, f, greatest(2, least(64, ceil(64 / f / (power(2, 0.5) - 1))))::INT AS n FROM f),
w AS (SELECT b, f, n, j, 0.5 - 0.5 * cos(2 * pi() * j / (n - 1)) AS w FROM (SELECT *, unnest(range(0, n)) AS j FROM n)), u AS (SELECT b, sum(abs(w)) AS u FROM w GROUP BY b),
c AS (SELECT s.id, t.t, w.b, n, sum(x * w * cos(2 * pi() * f / 64 * (j - n / 2.0))) AS re, sum(x * w * sin(2 * pi() * f / 64 * (j - n / 2.0))) AS im
  FROM w, (SELECT unnest(range(0, 5)) AS t) t JOIN signal s ON s.pos = 16 * t.t + j - n // 2 GROUP BY s.id, t.t, w.b, n)
SELECT id, t::INT AS t, c.b::INT AS b, round(sqrt(re * re + im * im) / u * sqrt(n), 5) AS v FROM c JOIN u USING (b)""",
        "signal",
    )
)
def constant_q(spark, d):
    found = V.signals(spark, d).select("id", F.posexplode(K.kernel(lambda x: K.cqt(x, 64.0, 16, 2, 4.0), K.IMAGE)("data")).alias("t", "row"))
    return found.select("id", "t", F.posexplode("row").alias("b", "v")).select("id", "t", "b", F.round("v", 5).alias("v"))


@query(sql("SELECT id, pos::INT AS pos, round(x, 6) AS x FROM signal", "signal"))
def spectra_to_signals(spark, d):
    """Frames to spectra and back: with the phases at hand the signal is as before."""
    return _samples(spark, d, K.kernel(lambda x: K.griffin_lim(K.stft(x, 16, 8), 16, 8, 1, phase=K.phases(x, 16, 8)))("data"))


_CONFIG = {"type": "MagSpectrogram", "rate": "64 Hz", "window": "1 s", "step": "1 s", "window_func": "hamming", "decibel": False}


@query(sql(f"WITH {DFT} SELECT id, 0 AS t, k, round(m, 5) AS m FROM dft", "signal"))
def represented_signals(spark, d):
    made = R.represent(V.signals(spark, d).withColumn("rate", F.lit(64.0)), _CONFIG)
    return made.select("id", F.posexplode("data").alias("t", "row")).select("id", "t", F.posexplode("row").alias("k", "m")).select("id", "t", "k", F.round("m", 5).alias("m"))


@query(sql(f"WITH {DFT} SELECT id, (k - 8)::INT AS k, round(20 * log10(m), 4) AS db FROM dft WHERE k BETWEEN 8 AND 16 AND m > 0", "signal"))
def represented_bands(spark, d):
    """Decibels of the bins from 8 to 16 Hz and a transform after them."""
    config = _CONFIG | {"decibel": True, "freq_min": "8 Hz", "freq_max": "16 Hz", "transforms": [{"name": "resize", "shape": [1, 9]}]}
    made = R.represent(V.signals(spark, d).withColumn("rate", F.lit(64.0)), config)
    return made.select("id", F.posexplode(F.get("data", F.lit(0))).alias("k", "db")).select("id", "k", F.round("db", 4).alias("db")).where("db IS NOT NULL")


@query("SELECT vec_id AS id, greatest(1, ceil((64 - 16) / 8.0) + 1)::INT AS times, 9 AS bins, greatest(1, ceil((64 - 16) / 8.0) + 1)::INT AS inferred_times, 9 AS inferred_bins FROM embeddings")
def inferred_shapes(spark, d):
    """The shape of every spectrogram, and that which its configuration gives for a second of signal."""
    config = {"type": "MagSpectrogram", "rate": "64 Hz", "window": "0.25 s", "step": "0.125 s", "decibel": False}
    times, bins = R.infer_shape(config, 1.0)
    made = R.represent(V.signals(spark, d).withColumn("rate", F.lit(64.0)), config)
    return made.select("id", F.size("data").alias("times"), F.size(F.get("data", F.lit(0))).alias("bins"), F.lit(times).alias("inferred_times"), F.lit(bins).alias("inferred_bins"))


@query("SELECT * FROM (VALUES ('encoded', true, 'rate', 1000.0), ('encoded', true, 'window', 0.256), ('encoded', true, 'step', 1.92), ('encoded', true, 'freq_max', 2500.0), ('parsed', false, 'rate', 1000.0), ('parsed', false, 'window', 0.256), ('parsed', false, 'step', 1.92), ('parsed', false, 'freq_max', 2500.0)) t(form, is_encoded, name, number)".replace("0.256)", "0.256::DOUBLE)"))
def parsed_configurations(spark, d):
    """Quantities with units, parsed, encoded and parsed again."""
    given = {"rate": "1 kHz", "window": "256 ms", "step": "0.032 min", "freq_max": "2500"}
    parsed = R.parse_config(given)
    again = R.encode_config(parsed)
    rows = [("encoded", R.is_encoded(again), k, float(v)) for k, v in R.parse_config(again).items()] + [("parsed", R.is_encoded(parsed), k, float(v)) for k, v in parsed.items()]
    return spark.createDataFrame(rows, "form string, is_encoded boolean, name string, number double")


@query("SELECT * FROM (VALUES ('label', 0), ('signal', 1), ('image', 2)) t(name, dimensions)")
def array_dimensions(spark, d):
    kinds = V.signals(spark, d).select("label", F.col("data").alias("signal"), _image().alias("image")).schema
    return spark.createDataFrame([(f.name, schema.dimensions(f.dataType)) for f in kinds], "name string, dimensions int")


# Images ------------------------------------------------------------------------------------------

_WEIGHTS = [math.exp(-0.5 * i * i) for i in range(-4, 5)]
_MIRROR = "CASE WHEN ({0} + 16) % 16 >= 8 THEN 15 - ({0} + 16) % 16 ELSE ({0} + 16) % 16 END"


@query(
    sql(
        f"""WITH w AS (SELECT i, exp(-0.5 * i * i) / {sum(_WEIGHTS)!r} AS w FROM (SELECT unnest(range(-4, 5)) AS i)),
t AS (SELECT filename, t_bin, i, f_bin FROM image, w), a AS (SELECT x.filename, t.t_bin, t.f_bin, sum(x.value * w.w) AS value FROM t JOIN w ON w.i = t.i JOIN image x ON x.filename = t.filename AND x.f_bin = t.f_bin AND x.t_bin = {_MIRROR.format("(t.t_bin + t.i)")} GROUP BY x.filename, t.t_bin, t.f_bin)
SELECT a.filename, p.t_bin, p.f_bin, round(sum(a.value * w.w), 6) AS value FROM image p, w JOIN a ON a.filename = p.filename AND a.t_bin = p.t_bin AND a.f_bin = {_MIRROR.format("(p.f_bin + w.i)")} GROUP BY a.filename, p.t_bin, p.f_bin""",
        "image",
    )
)
def blurred_images(spark, d):
    return _long(_images(spark, d).withColumn("data", K.kernel(lambda a: K.blur(a, 1.0, 1.0), K.IMAGE, image=True)("data")))


@query(
    sql(
        """WITH t AS (SELECT i, greatest(0, least(7, (i + 0.5) * 2 - 0.5)) AS p FROM (SELECT unnest(range(0, 4)) AS i)), f AS (SELECT i, greatest(0, least(7, (i + 0.5) / 2 - 0.5)) AS p FROM (SELECT unnest(range(0, 16)) AS i))
SELECT x.filename, t.i::INT AS t_bin, f.i::INT AS f_bin, round(sum(x.value * greatest(0, 1 - abs(t.p - x.t_bin)) * greatest(0, 1 - abs(f.p - x.f_bin))), 6) AS value FROM image x, t, f GROUP BY x.filename, t.i, f.i""",
        "image",
    )
)
def resized_images(spark, d):
    return _long(_images(spark, d).withColumn("data", K.kernel(lambda a: K.resize(a, (4, 16)), K.IMAGE, image=True)("data")))


@query(
    sql(
        """WITH b AS (SELECT filename, t_bin, f_bin, (value > 0.1)::INT::DOUBLE AS v FROM image)
SELECT b.filename, b.t_bin, b.f_bin, CASE WHEN b.v = 1 AND NOT EXISTS (SELECT 1 FROM b n WHERE n.filename = b.filename AND n.v = 1 AND abs(n.t_bin - b.t_bin) <= 1 AND abs(n.f_bin - b.f_bin) <= 1 AND (n.t_bin, n.f_bin) <> (b.t_bin, b.f_bin)) THEN 0 ELSE b.v END AS value FROM b""",
        "image",
    )
)
def isolated_spots(spark, d):
    marked = F.transform("data", lambda row: F.transform(row, lambda v: (v > 0.1).cast("double")))
    return _long(_images(spark, d).withColumn("data", K.kernel(K.drop_isolated, K.IMAGE, image=True)(marked)))


@query(
    sql(
        """WITH n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM image WINDOW w AS (PARTITION BY filename, f_bin ORDER BY t_bin))
SELECT filename, t_bin, (coalesce(sum((value > a AND value > b)::INT), 0) >= 3)::INT AS peak FROM n GROUP BY filename, t_bin""",
        "image",
    )
)
def peaks(spark, d):
    return X.detect_peaks(_images(spark, d), multiplicity=3, prominence=0.0).select("filename", F.posexplode("peaks").alias("t_bin", "peak"))


# Networks ----------------------------------------------------------------------------------------


def _network() -> M.Network:
    """A network of one hidden layer with weights by formula."""
    p, j, c = np.arange(64)[:, None], np.arange(16), np.arange(10)
    weights = {"1.w": np.cos(p * 16 + j) / 8, "1.b": np.sin(j) / 10, "top.w": np.sin(np.arange(16)[:, None] * 10 + c) / 4, "top.b": np.cos(c) / 10}
    return M.Network(M.dense_recipe([16], 10), (64,), weights=weights)


_NETWORK = """h AS (SELECT id, label, j, greatest(0, sum(x * cos(pos * 16 + j) / 8) + sin(j) / 10) AS h FROM signal, (SELECT unnest(range(0, 16)) AS j) GROUP BY id, label, j),
z AS (SELECT id, label, c, sum(h * sin(j * 10 + c) / 4) + cos(c) / 10 AS z FROM h, (SELECT unnest(range(0, 10)) AS c) GROUP BY id, label, c),
p AS (SELECT id, label, c, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM z)"""


@query(sql(f"WITH {_NETWORK} SELECT id, arg_max(c, p)::INT AS class_id, round(max(p), 6) AS confidence FROM p GROUP BY id", "signal"))
def model_scores(spark, d):
    """A network, saved and loaded again, over all signals."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        _network().save(f"{folder}/model.zip")
        net, _ = M.Network.load(f"{folder}/model.zip")
    return M.score(V.signals(spark, d), net).select("id", scalar.class_and_confidence(F.col("scores")).alias("c")).select("id", "c.class_id", F.round("c.confidence", 6).alias("confidence"))


@query(
    sql(
        f"""WITH {_NETWORK}, b AS (SELECT id, label, max(p) AS top, max(CASE WHEN c = label THEN p END) AS own, max(CASE WHEN c = 1 THEN p END) AS one FROM p GROUP BY id, label)
SELECT round(avg(-ln(least(greatest(own, 1e-7), 1 - 1e-7))), 6) AS loss, round(avg((own = top)::INT), 6) AS accuracy, count(*) AS n, round(avg(((label = 1)::INT - one) * ((label = 1)::INT - one)), 6) AS mse, count_if(label = 1 AND one >= 0.5)::BIGINT AS tp FROM b""",
        "signal",
    )
)
def model_evaluation(spark, d):
    recipe = M.Recipe([], 10, metrics=[{"recipe_name": k, "parameters": {}} for k in ("MeanSquaredError", "TruePositives")])
    got = M.evaluate(M.score(V.signals(spark, d), _network()), recipe=recipe)
    return got.select(*rounded("loss", "accuracy"), "n", F.round("MeanSquaredError", 6).alias("mse"), F.col("TruePositives").alias("tp"))


@query(sql(f"WITH {_NETWORK}, g AS (SELECT id, c, p - (c = label)::INT AS g FROM p) SELECT j::INT AS j, c::INT AS c, round(sum(h.h * g.g), 4) AS gradient FROM h JOIN g USING (id) GROUP BY j, c", "signal"))
def summed_gradients(spark, d):
    """Gradients of the top layer at the present weights, summed over all signals: a step of training."""
    _, _, sums = M.summed_gradients(V.signals(spark, d), _network())
    rows = [(j, c, round(float(v), 4)) for (j, c), v in np.ndenumerate(sums["top.w"])]
    return spark.createDataFrame(rows, "j int, c int, gradient double")


@query(sql(f"WITH {_NETWORK} SELECT 0.1::DOUBLE AS threshold, 'f' || id % 7 AS filename, (id // 7)::DOUBLE AS start, 3.0::DOUBLE AS duration, round(p, 6) AS score FROM p WHERE c = 1 AND p >= 0.1", "signal"))
def model_detections(spark, d):
    """Scores of a table of inputs as detections of one class."""
    table = V.signals(spark, d).select(F.concat(F.lit("f"), F.col("id") % 7).alias("filename"), F.floor(F.col("id") / 7).cast("double").alias("offset"), "data")
    return M.detect(table, _network(), label=1, threshold=0.1, spec_dur=3.0).withColumn("score", F.round("score", 6))


def _convolutions() -> M.Network:
    """A convolution of 3 x 3 to two channels, maxima of 2 x 2 and the top, with weights by formula."""
    a, b, k = np.arange(3)[:, None, None], np.arange(3)[None, :, None], np.arange(2)
    weights = {"0.w": np.cos(a * 6 + b * 2 + k)[:, :, None, :] / 2, "0.b": np.array([0.1, -0.1]), "top.w": np.sin(np.arange(32)[:, None] * 10 + np.arange(10)) / 4, "top.b": np.cos(np.arange(10)) / 10}
    return M.Network(M.cnn_recipe([2], [], 10), (8, 8), weights=weights)


@query(
    sql(
        """WITH w AS (SELECT a, b, k, cos(a * 6 + b * 2 + k) / 2 AS w FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b), (SELECT unnest(range(0, 2)) AS k)),
c AS (SELECT p.filename, p.t_bin AS y, p.f_bin AS x, w.k, greatest(0, sum(coalesce(i.value, 0) * w.w) + CASE w.k WHEN 0 THEN 0.1 ELSE -0.1 END) AS v
  FROM image p CROSS JOIN w LEFT JOIN image i ON i.filename = p.filename AND i.t_bin = p.t_bin + w.a - 1 AND i.f_bin = p.f_bin + w.b - 1 GROUP BY p.filename, p.t_bin, p.f_bin, w.k),
m AS (SELECT filename, (y // 2) * 8 + (x // 2) * 2 + k AS j, max(v) AS v FROM c GROUP BY ALL),
z AS (SELECT filename, c, sum(v * sin(j * 10 + c) / 4) + cos(c) / 10 AS z FROM m, (SELECT unnest(range(0, 10)) AS c) GROUP BY filename, c),
p AS (SELECT filename, c, exp(z) / sum(exp(z)) OVER (PARTITION BY filename) AS p FROM z)
SELECT filename AS id, c::INT AS c, round(p, 6) AS p FROM p""",
        "image",
    )
)
def convolution_scores(spark, d):
    images = _images(spark, d).withColumnRenamed("filename", "id")
    return M.score(images, _convolutions()).select("id", F.posexplode("scores").alias("c", "p")).select("id", "c", *rounded("p"))
