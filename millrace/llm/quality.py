"""Quality rules: base rules plus gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (FIT_ROWS) by histogram boosting with
monotonic constraints, then flattened into numpy node arrays; scoring walks all trees for a whole
batch level by level.

Defined cases: a null text counts as empty; an empty text has 0 words, so it fails the base rule;
texts are read whole, however long; repeated rows and null ids are scored row by row; other columns
are never read, whatever their names; with no labelled rows of both classes the verdict is "keep"; ids may be of
any type; a score at the threshold keeps; of equally good splits the first feature's lowest is taken.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

FIT_ROWS = 4000
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?;:=_~^@/\\{}[]()"

FEATURES = (
    "log_words", "word_len", "symbol_ratio", "upper_ratio", "digit_ratio", "dup_line_ratio",
    "repeat_ratio", "unique_ratio", "pipe_ratio", "mark_ratio", "words_per_line", "longest_word", "period_ratio", "adjacent_ratio",
)
#: -1: quality must not rise with the feature; 0: free.
MONOTONE = (0, 0, -1, -1, 0, -1, -1, 0, -1, -1, 0, 0, 0, -1)

BASE = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())])
BASE_DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    many = {g for g, n in Counter(grams).items() if n > 1}
    at = np.fromiter((g in many for g in grams), dtype=bool, count=len(grams))
    hit = np.zeros(len(words), dtype=bool)
    hit[:-2] |= at
    hit[1:-1] |= at
    hit[2:] |= at
    return int(hit.sum())


def statistics(text: str | None) -> tuple[tuple, tuple]:
    """The base counts and the features of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(words)
    failed = n < 50 or 100 * rep > 50 * n
    chars = max(word_chars, 1)
    count = max(n, 1)
    dropped = lambda some: len(raw) - len(raw.translate(None, some))
    same = sum(map(bytes.__eq__, words, words[1:]))
    features = (
        np.log1p(n), word_chars / count, n_symbols / chars, dropped(UPPER) / chars, dropped(DIGITS) / chars,
        dup / max(len(lines), 1), rep / count, len(set(words)) / count, text.count("|") / count, dropped(MARKS) / count,
        n / max(len(lines), 1), float(max(map(len, words), default=0)), text.count(".") / count, same / count,
    )
    return (n, word_chars, n_symbols, dup, rep, failed), features


class Trees:
    """Boosted trees of one depth as flat arrays: node i of tree t has its children at 2i+1, 2i+2."""

    def __init__(self, depth: int, bias: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.depth, self.bias, self.feature, self.cut, self.leaf = depth, bias, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, all rows and trees together."""
        total = np.full(len(x), self.bias)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
            total += self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 5, ridge: float = 2.0) -> Trees:
    """Histogram gradient boosting with logistic loss.

    A split on a constrained feature is taken only if its child values are in order, and the
    middle of the two bounds all leaves below, so the whole tree is monotone.
    """
    n_nodes, n_leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        bias = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return Trees(depth, bias if len(y) else 4.0, np.zeros((0, n_nodes), int), np.zeros((0, n_nodes)), np.zeros((0, n_leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    margin = np.full(len(y), bias)
    feats, cutoffs, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
        feature, cut, leaf = np.zeros(n_nodes, int), np.full(n_nodes, np.inf), np.zeros(n_leaves)
        where = np.zeros(len(y), int)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(n_nodes):
            rows = np.flatnonzero(where == node)
            low, high = bounds[node]
            best = (1e-9, None)
            g, h = grad[rows], hess[rows]
            G, H = g.sum(), h.sum()
            if len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    size = len(c) + 1
                    gl = np.cumsum(np.bincount(b, g, size))[:-1]
                    hl = np.cumsum(np.bincount(b, h, size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    vl = np.clip(gl / (hl + ridge), low, high)
                    vr = np.clip((G - gl) / (H - hl + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * monotone[f] < 0)
                    gain[bad] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
            left, right = 2 * node + 1, 2 * node + 2
            bounds[left] = bounds[right] = (low, high)
            if best[1]:
                f, k, vl, vr = best[1]
                feature[node], cut[node] = f, cuts[f][k]
                over = binned[rows, f] > k
                where[rows] = np.where(over, right, left)
                if monotone[f]:
                    mid = (vl + vr) / 2
                    bounds[left], bounds[right] = ((low, mid), (mid, high)) if monotone[f] > 0 else ((mid, high), (low, mid))
            else:
                where[rows] = left
        for k in range(n_leaves):
            rows = np.flatnonzero(where == n_nodes + k)
            low, high = bounds[n_nodes + k]
            if len(rows):
                leaf[k] = rate * np.clip(grad[rows].sum() / (hess[rows].sum() + ridge), low, high)
        margin += leaf[where - n_nodes]
        feats.append(feature), cutoffs.append(cut), leaves.append(leaf)
    return Trees(depth, bias, np.array(feats), np.array(cutoffs), np.array(leaves))


def _features(batches):
    for b in batches:
        rows = [statistics(t)[1] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([[float(v) for v in r] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fit on at most `rows` labelled documents (the bound; a hash of the id picks them)."""
    common.small_batches(docs.sparkSession)
    got = common.labelled_texts(docs, labels, "quality", rows).select("y", "text").mapInArrow(_features, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return fit(np.array([r[1] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[0] for r in got]))


def scored(docs: DataFrame, model: Trees, out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column `out`: the base counts, base_failed, kept and score."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([*BASE, ("kept", pa.bool_()), ("score", pa.float64())])

    def start():
        def run(texts):
            both = [statistics(t) for t in texts]
            p = model.score(np.array([b[1] for b in both]).reshape(len(both), len(FEATURES)))
            cols = {f.name: [b[0][i] for b in both] for i, f in enumerate(BASE)}
            cols["score"] = p
            cols["kept"] = [bool(s >= threshold and not b[0][5]) for s, b in zip(p, both)]
            return cols

        return run

    udf = common.text_struct(start, schema, f"{BASE_DDL}, kept boolean, score double")
    return docs.withColumn(out, udf(F.col("text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit_on_labels(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "quality.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: the documents that pass, with their own columns."""
    name = common.free_name(docs, "quality")
    return scored(docs, fit_on_labels(docs, labels), name).filter(F.col(f"{name}.kept")).drop(name)
