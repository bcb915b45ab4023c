"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most 4 bits
share at least 8 - 4 = 4 positional bytes: the guaranteed minimum of matches. Lists of one positional byte would
hold a 256th of all rows each, so the index has lists of three: SUBSETS is a smallest set of triples such that
any four positions contain one of them (20 of 56), so each pair that reaches the minimum meets.
Under a list the shared positional bytes of its pairs are tallied, the pairs that reach the minimum
are retained, and those verified by Hamming distance. Equal fingerprints are one entry.

Lists with two entries carry their pair in the aggregate itself (min and max). Larger ones are
walked breadth-first, never pair by pair: a found member leaves the list, and a component is told
as links to its smallest member. Lists of more than KEY_LIMIT entries are split, again and again: first by the
fourth shared byte (a retained pair has one among the other five positions), then by 2 of 6 blocks of the bits
that are still free (at most 4 of which can differ in a linked pair). All of it is exact. Under
FREE_BITS free bits a list holds 2**FREE_BITS distinct entries at most and is walked as it is.

Rows of one fingerprint can be any share of all rows, so they are joined to their class by the
fingerprint and one of SALTS parts of the ids.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked
like any other; repeated rows each get a row; a null id never is a component's smallest id unless all
its ids are null; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import common, setjoin
from millrace.llm.components import components

BITS_APART = 4
MATCHES = 8 - BITS_APART
KEY_LIMIT = 20_000
FREE_BITS = 14
SALTS = 32


def turan_triples(groups: tuple[tuple[int, ...], ...] = ((0, 1, 2), (3, 4, 5), (6, 7))) -> list[tuple[int, ...]]:
    """Triples of positions within one of three groups, or with two in a group and one in the next:
    of any four positions two lie in one group, and a third in it or in the next or the one before."""
    where = {p: g for g, members in enumerate(groups) for p in members}

    def taken(triple) -> bool:
        count = [sum(where[p] == g for p in triple) for g in range(3)]
        return 3 in count or 2 in count and count[(count.index(2) + 1) % 3] == 1

    return [t for t in combinations(sorted(where), 3) if taken(t)]


SUBSETS = turan_triples()


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the 64-bit hashes, as a signed integer; in pieces, to bound memory."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step].astype(">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a whole text; zero if it has no words."""
    return majority(setjoin.shingles(setjoin.words_of(text), shingle))


def fingerprinted(docs: DataFrame, shingle: int, out: str = "fp") -> DataFrame:
    common.small_batches(docs.sparkSession)
    udf = common.text_struct(lambda: lambda texts: {"v": [fingerprint(t, shingle) for t in texts]}, pa.schema([("v", pa.int64())]), "v bigint")
    return docs.withColumn(out, udf(F.col("text"))["v"])


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def _packed(parts: list[tuple[Column, int]]) -> Column:
    """Parts of the given widths side by side in one long."""
    out = parts[0][0]
    for part, width in parts[1:]:
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def _keys(fps: DataFrame) -> DataFrame:
    fp = F.col("fp")
    each = [F.shiftleft(F.lit(s).cast("long"), 24).bitwiseOR(_packed([(_byte(fp, p), 8) for p in subset])) for s, subset in enumerate(SUBSETS)]
    return fps.select("fp", F.explode(F.array(*each)).alias("key"))


def _tally(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    return sum(((_byte(a.bitwiseXOR(b), p) == 0).cast("int") for p in range(8)), F.lit(0))


def tally(apart: np.ndarray) -> np.ndarray:
    """The shared positional bytes of pairs, from their xor: each byte's bits are folded onto its lowest."""
    x = apart | apart >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def _split(batches):
    """Members of dense lists (key, fp, free bits) to the lists they are split into: the fourth shared byte
    while five positions are free, else 2 of 6 blocks of the free bits."""
    for b in batches:
        keys, fps, free = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("key", "fp", "free"))
        out: list[list] = [[], [], []]
        for mask in np.unique(free):
            rows = free == mask
            bits = [i for i in range(64) if int(mask) >> i & 1]
            if len(bits) == 40:
                fixed = [sum(1 << i for i in bits[8 * k : 8 * k + 8]) for k in range(5)]
            else:
                cut = [bits[len(bits) * k // 6 : len(bits) * (k + 1) // 6] for k in range(6)]
                fixed = [sum(1 << i for i in x + y) for x, y in combinations(cut, 2)]
            for k, f in enumerate(fixed):
                same = fps[rows] & np.uint64(f)
                out[0].append([xxh64_intdigest(x.tobytes() + v.tobytes(), k) for x, v in zip(keys[rows], same)])
                out[1].append(fps[rows])
                out[2].append(np.full(rows.sum(), int(mask) & ~f, np.uint64))
        cols = [np.concatenate([np.asarray(x, np.uint64) for x in c]).view(np.int64) if c else np.zeros(0, np.int64) for c in out]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "fp", "free"])


def star_links(fps: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct fingerprints at <= apart bits: (first, member).
    Pairs are tried only if their tally reaches the minimum."""
    rest = np.unique(fps.view(np.uint64))
    left, right = [], []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        todo = np.array([seed], np.uint64)
        while len(todo) and len(rest):
            size = max(1, 1_000_000 // len(rest))
            now, todo = todo[:size], todo[size:]
            xor = now[:, None] ^ rest[None, :]
            hit = tally(xor) >= 8 - apart
            hit[hit] = np.bitwise_count(xor[hit]) <= apart
            hit = hit.any(axis=0)
            found, rest = rest[hit], rest[~hit]
            todo = np.concatenate([todo, found])
            left.append(np.full(len(found), seed, np.uint64))
            right.append(found)
    join = lambda x: (np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64)
    return join(left), join(right)


def _walk(batches):
    for b in batches:
        pairs = [star_links(np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64)) for v in b.column("fps")]
        left, right = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all
    links at <= BITS_APART bits. Lists of one entry are pruned before any list gets its members."""
    spark = fps.sparkSession
    common.small_batches(spark)
    keys = _keys(fps)
    met = common.written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-keys")
    near = (_tally(F.col("a"), F.col("b")) >= MATCHES) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART)
    found = met.filter((F.col("n") == 2) & near).select("a", "b")
    walk = lambda rows: rows.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_walk, "a bigint, b bigint")
    found = found.unionByName(walk(keys.join(met.filter((F.col("n") > 2) & (F.col("n") <= KEY_LIMIT)).select("key"), "key")))
    dense = met.filter(F.col("n") > KEY_LIMIT).select("key")
    if dense.isEmpty():
        return found.distinct()
    whole = (1 << 64) - 1
    masks = [whole & ~sum(255 << 8 * p for p in s) for s in SUBSETS]
    free = F.element_at(F.array(*[F.lit(m - (1 << 64) * (m >> 63)) for m in masks]), F.shiftrightunsigned("key", 24).cast("int") + 1)
    rows = keys.join(dense, "key").select("key", "fp", free.alias("free"))
    while True:
        rows = common.written(rows.mapInArrow(_split, "key bigint, fp bigint, free bigint"), "simhash-split")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.bit_count("free")).alias("bits")).filter("n > 1")
        more = (F.col("n") > KEY_LIMIT) & (F.col("bits") > FREE_BITS)
        found = found.unionByName(walk(rows.join(sizes.filter(~more).select("key"), "key")))
        dense = common.written(sizes.filter(more).select("key"), "simhash-dense")
        if dense.isEmpty():
            return found.distinct()
        rows = rows.join(dense, "key")


def named(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) for entries (fp, first_id) linked by the edges (a, b): root is the component's
    smallest entry, component_id the least first_id in it."""
    roots = components(edges, "simhash-components")
    of = F.coalesce("root", "fp").alias("root")
    linked = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", of, "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    several = least.filter("n > 1").select(F.col("root").alias("r"), F.col("component_id").alias("least_id"))
    return linked.join(several, F.col("root") == F.col("r"), "left").select("fp", "root", F.coalesce("least_id", "first_id").alias("component_id"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    prints = common.written(fingerprinted(docs, 4).select("doc_id", "fp", salt.alias("salt")), "simhash-prints")
    fps = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), common.salts_seen("salt").alias("salts")), "simhash-fps")
    classes = named(fps.select("fp", "first_id"), links(fps.select("fp"))).select("fp", "component_id")
    parts = classes.join(fps.select("fp", F.explode(common.salts_of("salts", SALTS)).alias("salt")), "fp")  # as many as the fingerprint has rows, SALTS at most
    return prints.join(parts, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def likely(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of entries (fp, sim) whose fingerprints sim are equal or in one component of links at BITS_APART bits."""
    firsts = common.written(entries.groupBy("sim").agg(F.min("fp").alias("first")), "near-dedup-sims")
    equal = entries.select("sim", "fp").join(firsts, "sim").filter(F.col("fp") != F.col("first")).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    end = lambda x: firsts.select(F.col("sim").alias(x), F.col("first").alias(f"of_{x}"))
    apart = links(firsts.select(F.col("sim").alias("fp"))).join(end("a"), "a").join(end("b"), "b")
    return equal.unionByName(apart.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The pipeline's stage: one document of each near-duplicate group stays (the one with the
    smallest id, then the smallest text hash; one row of wholly equal ones), with its own columns.
    Groups are linked by pairs whose shingle sets have a Jaccard similarity of 0.8 or more. The fingerprints and
    their index come first, as in op8, and what they link is verified by the sets. At 4 bits they miss
    most edited copies, so the sets whose components are still apart are then joined exactly (setjoin.py). A group is known by its entries,
    not by ids, so documents that share an id but not their text are apart, and null ids are no obstacle.

    To choose, ids, hashes, prefixes and the sets that met are shuffled, and the texts of those;
    all texts are shuffled once, to be filtered, and again only those of rows that stand several times.
    Each table made on the way goes as soon as nothing reads it.
    """
    spark = docs.sparkSession
    common.release(spark)
    mine = [common.free_name(docs, x) for x in ("id", "hash", "copies", "text", "part")]
    c_id, c_hash, c_copies, text, part = mine
    chosen = common.settled(spark, lambda: _chosen(docs, shingle).toDF(c_id, c_hash, c_copies), "near-dedup-chosen")
    marked = docs.withColumn(text, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(c_id)) & (F.col(text) == F.col(c_hash))
    once = marked.join(chosen.filter(F.col(c_copies) == 1).hint("shuffle_hash"), same, "left_semi").drop(text)
    again = chosen.filter(F.col(c_copies) > 1)
    if again.isEmpty():
        return once
    # a row can stand any number of times, so these meet in parts
    right = f"{part}_"
    spread = again.withColumn(right, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = marked.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    several = dealt.join(spread.hint("shuffle_hash"), same & (F.col(part) == F.col(right)), "left_semi").drop(part)
    return once.unionByName(several.dropDuplicates(["doc_id", text]).drop(text))


def _chosen(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash of the text, copies) of the document that stays of each group."""
    spark = docs.sparkSession
    prints = common.written(setjoin.described(docs.select("doc_id", "text"), shingle, majority), "near-dedup-prints")
    one = F.min(F.struct("hash", "n", "sim", "prefix", "bitmap")).alias("k")
    entries = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), one).select("fp", "first_id", "k.*"), "near-dedup-entries")
    rows = common.written(prints.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("copies")), "near-dedup-rows")
    common.drop_written(spark, prints)
    near = common.settled(spark, lambda: likely(entries), "near-dedup-likely")
    edges = common.settled(spark, lambda: setjoin.links(docs, entries, shingle, near), "near-dedup-links")
    groups = named(entries.select("fp", "first_id"), edges).select("fp", "root")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "copies")).alias("best"))
    best = first.join(groups, "fp").groupBy("root").agg(F.min("best").alias("k"))
    return best.select("k.doc_id", "k.hash", "k.copies")
