"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled texts train a small network on statistics
of a text. The risk is the non-negative unbiased one (Kiryo et al., 2017): with class prior p,
  R = p * R_P(+) + max(0, R_U(-) - p * R_P(-)),
and where the second term is negative its gradient is turned round. The prior is estimated
from the data: the smallest ratio of unlabelled to positive mass over score thresholds of a
first positive-against-unlabelled model. Labels of bad texts are never used.
"""

from __future__ import annotations

from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import documents, workers_ready

#: The bound of the sample that the model is fitted on: so many positives and as many unlabelled texts.
SAMPLE = 10_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 16
EPOCHS = 250
SEED = 7


def features_of(data: bytes) -> list[float]:
    n = len(data)
    if not n:
        return [0.0] * N_FEATURES
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    high, space = c[128:].sum(), c[9:14].sum() + c[32]
    usual = c[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    other = n - upper - lower - digit - high - space - usual
    distinct = len(set(words)) / k
    return [
        min(np.log1p(k) / 8, 2.0),
        min((n - space) / k / 8, 4.0),
        np.sqrt(upper / n),
        np.sqrt(digit / n),
        np.sqrt(other / n),
        np.sqrt(c[33] / n),
        np.sqrt(high / n),
        np.sqrt(usual / n),
        space / n,
        distinct,
        (distinct - min(1.0, 3.0 / np.sqrt(k))) if k > 9 else 0.0,
        np.sqrt(sum(map(eq, words, words[1:])) / k) * min(1.0, k / 30),
        np.sqrt(sum(len(w) == 1 for w in words) / k),
        len(set(lines)) / len(lines),
        np.sqrt(max(0.0, 1 - sum(w[-1:].isalnum() or w[-1:] > b"\x7f" for w in words) / k)),
    ]


N_FEATURES = 15


class Model:
    """One hidden layer of rectified units over standardised features."""

    def __init__(self, mean, scale, w1, b1, w2, b2) -> None:
        self.mean, self.scale, self.weights = mean, scale, [w1, b1, w2, b2]

    @staticmethod
    def fresh(x: np.ndarray, rng: np.random.Generator) -> Model:
        scale = x.std(axis=0)
        d = x.shape[1]
        return Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(z @ w1 + b1, 0)
        return h @ w2 + b2[0], h, z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[0], -30, 30)))

    def back(self, slope: np.ndarray, h: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        hidden = slope[:, None] * self.weights[2] * (h > 0)
        return [z.T @ hidden, hidden.sum(0), h.T @ slope, np.array([slope.sum()])]


def fit(x: np.ndarray, positive: np.ndarray, slopes, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Adam on slopes(scores, positive), the gradient of a risk by each row's output."""
    model = Model.fresh(x, np.random.default_rng(seed))
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, epochs + 1):
        out, h, z = model.forward(x)
        sig = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        for i, g in enumerate(model.back(slopes(out, sig, positive), h, z)):
            g = g + 1e-4 * model.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            model.weights[i] = model.weights[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def _plain(out, sig, positive):
    return np.where(positive, (sig - 1) / max(1, positive.sum()), sig / max(1, (~positive).sum()))


def _non_negative(prior: float):
    def slopes(out, sig, positive):
        soft = np.logaddexp(0, out)  # loss of calling a row positive when it is not
        n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
        rest = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        side = 1.0 if rest >= 0 else -1.0
        good = prior * (sig - 1) / n_p
        return np.where(positive, (good if side > 0 else 0.0) - side * prior * sig / n_p, side * sig / n_u)

    return slopes


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of mass above a threshold, over thresholds that keep at least three
    in four of the positives, less a twentieth: a prior a little too low moves scores a little
    down, one too high makes bad texts look good."""
    ratios = [(unlabelled >= t).mean() / (positive >= t).mean() for t in np.quantile(positive, np.linspace(0.0, 0.25, 26))]
    return float(min(0.99, max(0.05, 0.95 * min(ratios))))


def train(x: np.ndarray, positive: np.ndarray) -> tuple[Model, float]:
    """x of positives and unlabelled rows; returns the model and the estimated prior. Without
    rows of both kinds every text scores one half."""
    if not len(x) or positive.all() or not positive.any():
        zero = np.zeros(N_FEATURES)
        return Model(zero, zero + 1, np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)), 0.5
    first, half = np.zeros(len(x)), np.arange(len(x)) % 2 == 0
    for part in (half, ~half):  # each half is scored by a model of the other
        first[part] = fit(x[~part], positive[~part], _plain, epochs=EPOCHS // 2).score(x[part])
    prior = estimated_prior(first[positive], first[~positive])
    return fit(x, positive, _non_negative(prior)), prior


def _rows(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.large_binary()).to_pylist()
    return np.array([features_of(t or b"") for t in texts], float).reshape(len(texts), N_FEATURES)


def _features(batches):
    for batch in batches:
        flat = _rows(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["positive", "x"])


def _scores(batches, model: Model, text: int, names: list[str], least: float | None):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            score = pa.array(model.score(_rows(part.column(text))))
            out = pa.RecordBatch.from_arrays([*part.columns, score], names)
            yield out if least is None else out.filter(pc.greater_equal(score, least))


def fold_of(id_col: str) -> Column:
    """The fold of an id; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Model, float]:
    """Fits on at most `sample` positives and `sample` unlabelled rows outside fold 0, taken in
    the order of a hash of their ids. Only ids and quality = 1 are read from labels."""
    workers_ready(docs.sparkSession)

    def some(ids: DataFrame) -> DataFrame:
        return ids.where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64(F.col("id"), F.lit(SEED)), "id").limit(sample)

    outside = fold_of(id_col) != 0
    good = some(labels.where("quality = 1").where(outside).select(F.col(id_col).alias("id"))).withColumn("positive", F.lit(True))
    any_ = some(docs.where(outside).select(F.col(id_col).alias("id"))).withColumn("positive", F.lit(False))
    picked = F.broadcast(good.unionByName(any_))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id").select("positive", "text")
    found = rows.mapInArrow(_features, "positive boolean, x array<double>").toArrow()
    x = found["x"].combine_chunks()
    flat = np.array(x.to_pylist(), float).reshape(found.num_rows, N_FEATURES)
    positive = np.array(found["positive"].to_pylist(), bool)
    order = np.lexsort((*flat.T, positive))  # the order of rows in a result is not fixed
    return train(flat[order], positive[order])


def with_score(df: DataFrame, model: Model, name: str, text_col: str = "text", least: float | None = None) -> DataFrame:
    """df with a score column; rows under `least` are left out. A null text counts as empty,
    and empty texts are scored like any other; rows with null or repeated ids are rows like
    any other; an empty table gives an empty result. Other columns pass through as they are;
    the name must be new (common.free_name finds one)."""
    workers_ready(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInArrow(partial(_scores, model=model, text=df.columns.index(text_col), names=schema.names, least=least), schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, _ = trained(docs, labels_of(spark, sf_dir))
    scored = with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
