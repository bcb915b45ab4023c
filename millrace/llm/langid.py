"""Language identification with a blended-spectrum string kernel.

k(x, z) counts the character 1- to 4-grams that two texts both hold (presence, not frequency),
over cos-normalised rows. Nyström landmarks give the kernel a finite feature map; one-versus-rest
kernel ridge regression is solved on it. As f(x) = (P_x L') A / |x| is a product of the presence row
with two fixed matrices, L'A is multiplied out once and a batch is scored by one matrix product.

N-grams are hashed to 2**BITS buckets, so of texts long enough to fill most buckets the kernel sees less.

Defined cases: a null text or one without a letter gets `und` and score 0; texts are read whole;
repeated rows and null ids are scored row by row; only text is read for a prediction, whatever
other columns there are; with nothing to learn from every row gets `und`; equal scores go to the language
first in alphabetical order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Rows to fit on, over all languages: each gets an equal part, but LEAST_ROWS at least. At most
#: LANGUAGES are learned, those with the most rows. These bounds are on labelled rows alone.
FIT_ROWS = 1600
LEAST_ROWS = 16
LANGUAGES = 200
LANDMARKS = 160
#: Texts to a matrix product: their dense rows take 128 KiB each.
PRODUCT_ROWS = 32
BITS = 15
LENGTHS = (1, 2, 3, 4)
UNKNOWN = "und"

_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def presence(text: str, row: np.ndarray) -> None:
    """Set row[h] = 1 for each hashed n-gram of the whole text, read in pieces to bound memory."""
    step, longest = 1 << 18, max(LENGTHS)
    for at in range(0, max(len(text), 1), step):
        piece = (" " if at == 0 else "") + text[max(0, at - longest + 1 if at else 0) : at + step].lower() + " "
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 128, _PLAIN[np.minimum(c, 127)], c)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, longest + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in LENGTHS:
                row[(h * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    def __init__(self, langs: list[str], matrix: np.ndarray) -> None:
        self.langs, self.matrix = langs, matrix

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        p = np.zeros((min(PRODUCT_ROWS, len(texts)), 1 << BITS), np.float32)
        for at in range(0, len(texts), PRODUCT_ROWS):
            some = texts[at : at + PRODUCT_ROWS]
            seen = np.array([has_letter(t) for t in some])
            if not self.langs or not seen.any():
                names += [UNKNOWN] * len(some)
                continue
            for i, t in enumerate(some):
                p[i] = 0
                if seen[i]:
                    presence(t, p[i])
            rows = p[: len(some)]
            f = (rows @ self.matrix) / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]
            e = np.exp(3 * (f - f.max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
            names += [self.langs[b] if s else UNKNOWN for b, s in zip(e.argmax(axis=1), seen)]
            scores[at : at + len(some)] = np.where(seen, e.max(axis=1), 0.0)
        return names, scores


def fit(packed: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Nyström features from landmarks taken from each language in turn, then ridge regression."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    by = [[i for i, x in enumerate(langs) if x == n] for n in names]
    turns = [g[k] for k in range(max(map(len, by))) for g in by if k < len(g)][:landmarks]
    rows = lambda some: np.unpackbits(np.frombuffer(b"".join(packed[i] for i in some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)
    unit = lambda m: m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    marks = unit(rows(turns))
    k_nm = np.concatenate([unit(rows(range(i, min(i + 128, len(packed))))) @ marks.T for i in range(0, len(packed), 128)])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    w = np.linalg.solve(phi.T @ phi + ridge * len(y) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, (marks.T @ (root @ w)).astype(np.float32))


def _packed(batches):
    for b in batches:
        out = []
        for t in b.column("text").to_pylist():
            row = np.zeros(1 << BITS, np.uint8)
            presence(t or "", row)
            out.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("order_"), pa.array(out, pa.binary())], names=["lang", "order_", "bits"])


def fit_on_documents(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most max(rows, LEAST_ROWS * languages) of the given documents, an equal number for each language,
    so that rare ones are learned too. A hash of id and text picks them (the same ones whatever the order
    of tasks; copies of a row count once); the driver gets one fixed-size bit row for each, never a text."""
    common.small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([], [])
    each = max(LEAST_ROWS, rows // len(counts))
    span = 1 << 40
    bounds = docs.sparkSession.createDataFrame([(r.lang, int(span * min(1.0, 1.2 * each / r.n))) for r in counts], "lang string, bound bigint")
    hashed = known.withColumn("order_", F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(span))).join(F.broadcast(bounds), "lang")
    chosen = hashed.filter("order_ < bound").select("lang", "order_", "text").dropDuplicates(["lang", "order_"])
    got: dict[str, list] = {r.lang: [] for r in counts}
    for r in chosen.mapInArrow(_packed, "lang string, order_ bigint, bits binary").collect():
        got[r.lang].append((r.order_, bytes(r.bits)))
    pairs = [(bits, lang) for lang in sorted(got) for _, bits in sorted(got[lang])[:each]]
    return fit([b for b, _ in pairs], [x for _, x in pairs])


def scored(docs: DataFrame, model: Model, out: str = "language") -> DataFrame:
    """docs with a struct column `out` of lang_pred and score."""
    common.small_batches(docs.sparkSession)

    def start():
        return lambda texts: dict(zip(("lang_pred", "score"), model.predict(texts)))

    udf = common.text_struct(start, pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]), "lang_pred string, score double")
    return docs.withColumn(out, udf(F.col("text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    held_out = common.crc_mod("doc_id", 5) == 0
    model = fit_on_documents(docs.select("doc_id", "lang", "text").filter(~held_out))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.*")
