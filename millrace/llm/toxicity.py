"""Toxicity: a second-order factorization machine over hashed terms.

Terms are lower-cased words, the stems of longer ones (besides the words themselves), and how often those recur,
hashed to 24 bits; all buckets associated with the label are the machine's features, each with a linear
weight and a factor vector, so that pairs of terms weigh in besides single ones. It is fitted on a bounded
sample (FIT_ROWS) of labelled rows. The form of the terms and the bar for them were chosen by cross-validation within
the rows that may be learned from.

Defined cases: a null text counts as empty; an empty text gets the bias alone; texts are read whole;
repeated rows and null ids are scored row by row; other columns are never read; without labelled
rows of both classes every score is that of the one class (0 without any); without a term that tells the
classes apart every score is the share of toxic rows; a score at the cut is toxic; ids may be of any type.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

FIT_ROWS = 8000
FACTORS = 8
BITS = 24
STEM = 6
CUT = 0.7
#: A bucket is a feature if it has so many sampled rows, and this chi-square with the label at least:
#: rarer or weaker ones would let the machine learn single rows by heart. Chi-square is at most the
#: number of rows, so on few rows this share of them is asked for instead.
LEAST_ROWS = 5
LEAST_CHI2 = 30.0
LEAST_CHI2_SHARE = 0.15

_TO_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text: its words, the stems of longer ones, and for a stem
    found again, that it stands twice, three times, or in one word of a hundred."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    stems = Counter([w[:STEM] for w in words if len(w) > STEM])
    found = [*map(crc32, set(words)), *map(crc32, stems, repeat(1))]
    for s, n in stems.items():
        if n > 1:
            found.append(crc32(s, 2))
            if n > 2:
                found.append(crc32(s, 3))
            if 100 * n >= len(words):
                found.append(crc32(s, 4))
    return np.unique(np.array(found, np.int64) & (2**BITS - 1))


class Machine:
    def __init__(self, active: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.active, self.bias, self.weight, self.factor = active, bias, weight, factor
        self.square = (factor**2).sum(axis=1)

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            h = terms(t)
            at = np.searchsorted(self.active, h)
            at[at == len(self.active)] = 0
            at = at[self.active[at] == h] if len(self.active) else at[:0]
            if len(at):
                v = self.factor[at].sum(axis=0)
                out[i] += self.weight[at].sum() + 0.5 * (v @ v - self.square[at].sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, active: np.ndarray, factors: int = FACTORS, steps: int = 400, rate: float = 0.05, ridge: float = 1e-5) -> Machine:
    """Full-batch Adam on logistic loss; x holds term presence, a column for each active bucket."""
    if len(y) and y.min() < y.max() and x.shape[1] == 0:
        return Machine(np.zeros(0, np.int64), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(0), np.zeros((0, factors)))
    if len(y) == 0 or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), -30.0 if len(y) == 0 or not y.max() else 30.0, np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(5)
    x = x.astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], factors)).astype(np.float32)
    b = np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (b, w, v)]
    for step in range(1, steps + 1):
        xv = x @ v
        margin = b[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y).astype(np.float32) / len(y)
        grads = (np.array([g.sum()]), x.T @ g + ridge * w, x.T @ (g[:, None] * xv) - v * (x.T @ g)[:, None] + ridge * v)
        for p, d, (m, s) in zip((b, w, v), grads, state):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(active, float(b[0]), w.astype(float), v.astype(float))


def _hashed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([terms(t).astype(np.int32) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["y", "h"])


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fit on at most `rows` of the given labelled rows, with every bucket that passes the bar.

    The counts behind the choice of buckets are aggregated by Spark; the driver gets the chosen buckets
    and, for each sampled row, those of its own.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sample = common.labelled_texts(docs, labels, "toxic", rows)
    hashed = common.written(sample.select("y", "text").mapInArrow(_hashed, "y double, h array<int>"), "toxic-terms")
    n, pos = hashed.agg(F.count("*"), F.sum("y")).first()
    active = np.zeros(0, np.int64)
    if n and 0 < pos < n:
        counts = hashed.select("y", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.sum("y").alias("a"))
        gap = F.col("a") * float(n) - F.col("c") * float(pos)
        chi = gap * gap / (F.col("c") * (n - F.col("c") + 0.5)) * (n / (pos * (n - pos)))
        passing = counts.filter((F.col("c") >= LEAST_ROWS) & (chi >= min(LEAST_CHI2, LEAST_CHI2_SHARE * n))).select("h").collect()
        active = np.array(sorted(r[0] for r in passing), np.int64)
    keep = F.array(*[F.lit(int(h)) for h in active]) if len(active) else F.array().cast("array<int>")
    got = sorted((r[0], sorted(r[1])) for r in hashed.select("y", F.array_intersect("h", keep)).collect())
    x = np.zeros((len(got), len(active)), np.float32)
    for i, (_, own) in enumerate(got):
        x[i, np.searchsorted(active, np.array(own, np.int64))] = 1
    common.drop_written(spark, hashed)
    return fit(x, np.array([y for y, _ in got]), active)


def scored(docs: DataFrame, model: Machine, out: str = "toxicity", cut: float = CUT) -> DataFrame:
    """docs with a struct column `out` of score and predicted."""
    common.small_batches(docs.sparkSession)

    def start():
        def run(texts):
            p = model.score(texts)
            return {"score": p, "predicted": (p >= cut).astype(np.int32)}

        return run

    udf = common.text_struct(start, pa.schema([("score", pa.float64()), ("predicted", pa.int32())]), "score double, predicted int")
    return docs.withColumn(out, udf(F.col("text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = common.table(spark, sf_dir, "labels")
    model = fit_on_labels(docs, labels.filter(common.crc_mod("doc_id", 3) != 1))
    return scored(docs, model).select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "toxicity.*")
