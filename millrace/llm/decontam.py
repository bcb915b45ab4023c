"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of normalised words. An item of m words may occur with k = m // 6
word edits (insertions, deletions, substitutions). Cut into k + 1 pieces, at least one piece then
stands unedited in the document; an Aho-Corasick automaton finds all exact piece hits in one pass
over the whole text, and Myers' bit-parallel algorithm verifies the words around each hit.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_CHARS characters, each
of which is one pass over the documents with its automaton. Nothing of the corpus is collected.

Defined cases: a null document text or item text counts as empty; an item without words never matches, nor
does one with a null id; an item of fewer than WORDS_PER_EDIT words, one word even, must stand unedited; of
equally good matches of an item the first is told; repeated items and documents are matched row by row; ids may be
of any type; columns with other names are kept and never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from millrace.llm import common

WORDS_PER_EDIT = 6
BLOCK_CHARS = 1_000_000

_MARKS = re.compile(r"[ -⁯　-〿\xa0-\xbf]+")
_TO_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """Lower-cased words with a space before, between and behind them."""
    t = (text or "").lower()
    if not t.isascii():
        t = _MARKS.sub(" ", unicodedata.normalize("NFC", t))
    return " " + b" ".join(t.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()).decode("utf-8", "surrogatepass") + " "


def pieces(words: list[str]) -> list[tuple[int, str]]:
    """The item's pieces as (word offset, piece between spaces), one more than its edit budget."""
    n = len(words) // WORDS_PER_EDIT + 1
    cut = [len(words) * i // n for i in range(n + 1)]
    return [(a, " " + " ".join(words[a:b]) + " ") for a, b in zip(cut, cut[1:])]


def myers(masks: dict[str, int], m: int, window: list[str]) -> tuple[int, int]:
    """The least edit distance of the m-word pattern to any stretch of the window, and where such
    a stretch ends (the first such end). masks: word -> bits of the pattern's positions."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(window):
        eq = masks.get(w, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        h_up = down | (full & ~(d | up))
        h_down = up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = (h_up << 1) & full
        h_down = (h_down << 1) & full
        up = (h_down | (full & ~(x | h_up))) & full
        down = h_up & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton and masks of one block of (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items, where = [], {}
        for item_id, text in items:
            words = normalise(text).split()
            if item_id is None or not words:
                continue
            masks: dict[str, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            for at, piece in pieces(words):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, len(words), len(words) // WORDS_PER_EDIT, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        """The items that the whole text holds, each with its best match."""
        if not self.items:
            return []
        line, words, best, tried, at, seen = normalise(text), None, {}, set(), 0, 0
        for end, (size, owners) in self.automaton.iter(line):
            start = end - size + 1
            words = words or line.split()
            seen += line.count(" ", at, start)  # hits come in order of their ends
            if start < at:
                seen -= line.count(" ", start, at)
            at = start
            for owner, offset in owners:
                item_id, m, budget, masks = self.items[owner]
                first = seen - offset  # where the item would begin without edits
                if (owner, first) in tried or best.get(owner, (1,))[0] == 0:
                    continue
                tried.add((owner, first))
                low = max(0, first - budget)
                edits, stop = myers(masks, m, words[low : first + m + budget])
                if edits <= budget and edits < best.get(owner, (budget + 1,))[0]:
                    best[owner] = (edits, low + stop)
        return [{"item_id": self.items[o][0], "edits": e, "end_word": s} for o, (e, s) in sorted(best.items())]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's (item_id, text) in blocks of bounded size, one partition at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if block and size + len(r[1] or "") > chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1] or ""))
        size += len(r[1] or "")
    yield block


def matched(docs: DataFrame, items: list[tuple[int, str]], out: str = "leaks", kind: DataType = LongType()) -> DataFrame:
    """docs with an array column `out` of the block's items they hold: item_id (of the type `kind`), edits, end_word."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(items)
    leak = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("edits", pa.int32()), ("end_word", pa.int64())]))

    def start():
        matcher = Matcher(sent.value)
        return lambda texts: {"v": [matcher.find(t) for t in texts]}

    udf = common.text_struct(start, pa.schema([("v", leak)]), f"v array<struct<item_id: {kind.simpleString()}, edits: int, end_word: bigint>>")
    return docs.withColumn(out, udf(F.col("text"))["v"])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    benchmark, out = common.table(spark, sf_dir, "benchmark"), None
    for block in blocks(benchmark):
        found = matched(docs, block, kind=benchmark.schema["item_id"].dataType).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: the documents that hold no benchmark item, with their own columns."""
    name = common.free_name(docs, "leaks")
    for block in blocks(benchmark):
        docs = matched(docs, block, name, benchmark.schema["item_id"].dataType).filter(F.size(name) == 0).drop(name)
    return docs
