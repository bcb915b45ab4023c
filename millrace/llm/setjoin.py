"""Links between texts whose word-shingle sets have a Jaccard similarity of 0.8 or more, exactly.

Texts with equal sets are one entry. Two sets at similarity t or more share one of the first
n - ceil(t n) + 1 members of each under any common order (prefix filter), so entries meet under those
alone. The order puts shingles that a sample of texts finds common last; it affects cost only.
A met pair is tried by size and by the members left after the places where it met, then by parity bitmaps (their
differing bits never exceed the sets' difference), then by the sets.

In a group of more than GROUP_LIMIT entries pairs are not formed. Its members are tried against a few of them
(stars); what that links, with the links of other groups, is one component for most members of a group of copies, and
members of one component need no further links. Those outside the group's main component are tried against all
members if they are at most GROUP_LIMIT; a group with more of them is walked with its sets in one task, where members
already linked are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import common
from millrace.llm.components import components

GROUP_LIMIT = 200
SAMPLE_TEXTS = 10_000
HOT_ROWS = 3
HOT_LIMIT = 500_000
#: Least bits of a bitmap; it has at least twice as many bits as its set has members.
BITMAP = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of a whole text's shingles of `size` words, repeats included; one of all its words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - size + 1, 1)
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in pairs), np.uint64, n)


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def near(common_members: int, n: int, m: int) -> bool:
    """Whether the Jaccard similarity is at least 0.8, in integers."""
    return 9 * common_members >= 4 * (n + m)


class Order(NamedTuple):
    """Shingles that are common in a sample, sorted, with their places: these come after all others."""

    hot: np.ndarray
    place: np.ndarray


def describe(every: np.ndarray, order: Order) -> tuple:
    """(fp, n, prefix, bitmap) of a text's shingles: hash and size of their set, its first members and its bitmap."""
    found = np.unique(every.view(np.int64))
    fp = xxh64_intdigest(found.tobytes(), 42)
    at = np.minimum(np.searchsorted(order.hot, found), max(len(order.hot) - 1, 0))
    place = np.where(order.hot[at] == found, order.place[at], -1) if len(order.hot) else np.full(len(found), -1)
    ordered = found[np.argsort(place, kind="stable")]
    bits = max(BITMAP, 1 << (2 * len(found) - 1).bit_length()) if len(found) else BITMAP
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    bitmap = np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)
    return fp - (1 << 64) * (fp >> 63), len(found), ordered[: prefix_size(len(found))] if len(found) else found, bitmap


def _sets(docs: DataFrame, size: int) -> Column:
    """Struct of fp and the sorted distinct shingles h of a text."""
    common.small_batches(docs.sparkSession)

    def run(texts):
        sets = [np.unique(shingles(words_of(t), size).view(np.int64)) for t in texts]
        prints = [xxh64_intdigest(s.tobytes(), 42) for s in sets]
        return {"fp": [p - (1 << 64) * (p >> 63) for p in prints], "h": sets}

    schema = pa.schema([("fp", pa.int64()), ("h", pa.list_(pa.int64()))])
    return common.text_struct(lambda: run, schema, "fp bigint, h array<bigint>")(F.col("text"))


def order_of(docs: DataFrame, size: int) -> Order:
    """The order from a tenth of the texts (SAMPLE_TEXTS of them at least). A passage that stands in a fixed share of all texts
    makes groups that grow with their number, so a sample of fixed size would miss ever larger groups."""
    total = docs.count()
    part = int((1 << 30) * min(1.0, max(SAMPLE_TEXTS, total // 10) / max(total, 1)))
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < part).select("text")
    each = some.select(_sets(docs, size).alias("s")).select("s.fp", "s.h").dropDuplicates(["fp"]).select(F.explode("h").alias("v"))
    common_ones = each.groupBy("v").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT_ROWS)
    listed = common.written(common_ones.orderBy(F.col("c").desc(), "v").limit(HOT_LIMIT), "setjoin-hot")
    rows = listed.toArrow()
    common.drop_written(docs.sparkSession, listed)
    value, count = (rows.column(c).to_numpy().astype(np.int64) for c in ("v", "c"))
    by = np.lexsort((value, count))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    sort = np.argsort(value)
    return Order(value[sort], place[sort])


def described(docs: DataFrame, size: int, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """docs (doc_id, text) as doc_id, hash of the text, fp, n, prefix, bitmap and sim, the fingerprint of all its shingles."""
    order = order_of(docs, size)
    long = pa.list_(pa.int64())
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int32()), ("prefix", long), ("bitmap", long), ("sim", pa.int64())])

    def run(texts):
        every = [shingles(words_of(t), size) for t in texts]
        told = [(*describe(h, order), fingerprint(h)) for h in every]
        return {name: [t[i] for t in told] for i, name in enumerate(schema.names)}

    udf = common.text_struct(lambda: run, schema, "fp bigint, n int, prefix array<bigint>, bitmap array<bigint>, sim bigint")
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), udf(F.col("text")).alias("s")).select("doc_id", "hash", "s.*")


def group_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the sets at similarity 0.8 or more."""
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.empty(len(values), np.int64)
    rare[np.argsort(count, kind="stable")] = np.arange(len(values))
    parts = np.split(rare[place], np.cumsum([len(s) for s in sets])[:-1])
    parts = [np.sort(p) for p in parts]
    comp, index, out = np.arange(len(sets)), {}, []
    for i in sorted(range(len(parts)), key=lambda i: len(parts[i])):
        p = parts[i][: prefix_size(len(parts[i]))].tolist()
        met = np.unique([j for v in p for j in index.get(v, ())]).astype(np.int64)
        met = met[comp[met] != comp[i]]
        while len(met):
            j = int(met[0])
            shared = len(np.intersect1d(parts[i], parts[j], assume_unique=True))
            if near(shared, len(parts[i]), len(parts[j])):
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
            met = met[1:]
            met = met[comp[met] != comp[i]]
        for v in p:
            index.setdefault(v, []).append(i)
    return out


def _folded(bitmap: str, other: str) -> Column:
    """A bitmap at the other's length: sizes that pass differ by a quarter, so lengths by one doubling."""
    half = (F.size(bitmap) / 2).cast("int")
    first, second = F.slice(bitmap, F.lit(1), half), F.slice(bitmap, half + 1, half)
    return F.when(F.size(bitmap) > F.size(other), F.zip_with(first, second, lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bitmap))


def _pairs(batches):
    """Pairs (a, b) within groups of (n, fp, pos, of): of different components, near in size, and with enough members
    left after the places where they meet. A similar pair passes this at the first member it shares."""
    for b in batches:
        g = b.column("g")
        n, fp, pos, of = (g.values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("n", "fp", "pos", "of"))
        sizes = np.diff(g.offsets.to_numpy())
        group = np.repeat(np.arange(len(sizes)), sizes)
        left, right = [], []
        for apart in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(group[:-apart] == group[apart:])
            j = i + apart
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (of[i] != of[j]) & (4 * np.maximum(n[i], n[j]) <= 5 * np.minimum(n[i], n[j])) & near(most, n[i], n[j])
            left.append(fp[i[ok]])
            right.append(fp[j[ok]])
        a, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c), pa.int64()), pa.array(np.maximum(a, c), pa.int64())], names=["a", "b"])


def _walked(batches):
    for b in batches:
        a, c = [], []
        for fps, sets in zip(b.column("fps"), b.column("sets")):
            fps, sets = fps.as_py(), [s.values.to_numpy(zero_copy_only=False) for s in sets]
            for i, j in group_links(sets):
                a.append(min(fps[i], fps[j]))
                c.append(max(fps[i], fps[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def _near(left: str, right: str) -> Column:
    """Whether the bitmaps of a pair (columns n and m of both sides) allow a similarity of 0.8."""
    apart = F.aggregate(F.zip_with(_folded(f"m{left}", f"m{right}"), _folded(f"m{right}", f"m{left}"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    n, m = F.col(f"n{left}"), F.col(f"n{right}")
    return F.when(4 * F.greatest(n, m) <= 5 * F.least(n, m), 9 * apart <= n + m).otherwise(False)


def sets_of(docs: DataFrame, entries: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(fp, h) with the whole sets of some entries (column fp, repeats allowed), from the texts."""
    wanted = common.written(entries.select("fp", "hash").join(some.select("fp").distinct(), "fp", "left_semi").select("hash"), "setjoin-wanted")
    texts = docs.select("text").withColumn("hash", F.xxhash64("text")).join(wanted, "hash", "left_semi").dropDuplicates(["hash"])
    return common.written(texts.select(_sets(docs, size).alias("s")).select("s.fp", "s.h"), "setjoin-sets")


def verified(docs: DataFrame, entries: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (a, b) of entries that have a similarity of 0.8 or more."""
    side = lambda x: entries.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    tried = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(_near("a", "b"))
    tried = common.written(tried.select("a", "b", "na", "nb"), "setjoin-pairs")
    sets = sets_of(docs, entries, tried.select(F.col("a").alias("fp")).unionByName(tried.select(F.col("b").alias("fp"))), size)
    of = lambda x: sets.select(F.col("fp").alias(x), F.col("h").alias(f"h{x}"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return tried.join(of("a"), "a").join(of("b"), "b").filter(9 * shared >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def links(docs: DataFrame, entries: DataFrame, size: int, likely: DataFrame) -> DataFrame:
    """Links (a, b) between entries (fp, n, hash of a text with that set, prefix, bitmap), whose
    components are those of all pairs at similarity 0.8 or more. `likely` pairs are verified first; members of one
    component of these are not paired again."""
    spark = docs.sparkSession
    first = common.settled(spark, lambda: verified(docs, entries, likely, size), "setjoin-first")
    roots = components(first, "setjoin-components")
    keys = entries.select("fp", "n", F.posexplode("prefix").alias("pos", "key"))
    count = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = common.written(keys.join(count, "key"), "setjoin-met")
    rooted = lambda some, roots: some.join(roots, F.col("fp") == F.col("node"), "left").withColumn("of", F.coalesce("root", "fp")).drop("node", "root")
    small = rooted(met.filter(F.col("size") <= GROUP_LIMIT), roots).groupBy("key").agg(F.collect_list(F.struct("n", "fp", "pos", "of")).alias("g"))
    pairs = small.select("g").mapInArrow(_pairs, "a bigint, b bigint")
    large = met.filter(F.col("size") > GROUP_LIMIT).select("key", "fp")
    dense = not large.isEmpty()
    if dense:
        of_first = rooted(large, roots)
        order = F.struct(F.xxhash64("fp").alias("h"), "fp", "of")
        ends = [F.min(F.struct("fp", "of")), F.max(F.struct("fp", "of"))] + [F.struct(f(order)["fp"].alias("fp"), f(order)["of"].alias("of")) for f in (F.min, F.max)]
        stars = of_first.groupBy("key").agg(F.array(*ends).alias("p")).select("key", F.explode("p").alias("p"))
        rays = of_first.join(stars, "key").filter(F.col("of") != F.col("p.of"))
        pairs = pairs.unionByName(rays.select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")))
    sure = common.settled(spark, lambda: first.unionByName(verified(docs, entries, pairs, size)), "setjoin-sure")
    if not dense:
        return sure
    members = common.written(rooted(large, components(sure, "setjoin-components")), "setjoin-members")
    parts = members.groupBy("key", "of").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "of")).alias("main"), F.sum("c").alias("all"))
    others = F.col("all") - F.col("main.c")
    open_ = common.written(parts.filter(others > 0).select("key", F.col("main.of").alias("main"), others.alias("others")), "setjoin-open")
    few, many = open_.filter(F.col("others") <= GROUP_LIMIT), open_.filter(F.col("others") > GROUP_LIMIT)
    sized = members.join(few.select("key", "main"), "key").join(entries.select("fp", "n", "bitmap"), "fp")
    end = lambda some, x: some.select("key", F.col("of").alias(f"of{x}"), F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    outside = end(sized.filter("of <> main"), "y")
    late = end(sized, "x").join(outside, "key").filter((F.col("ofx") != F.col("ofy")) & _near("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = common.settled(spark, lambda: verified(docs, entries, late, size), "setjoin-late")
    if many.isEmpty():
        return sure.unionByName(found)
    walked = members.join(many.select("key"), "key")
    walked = walked.join(sets_of(docs, entries, walked, size), "fp").groupBy("key").agg(F.collect_list(F.struct("fp", "h")).alias("g"))
    walked = walked.select(F.col("g.fp").alias("fps"), F.col("g.h").alias("sets")).mapInArrow(_walked, "a bigint, b bigint")
    return sure.unionByName(found).unionByName(walked).distinct()
