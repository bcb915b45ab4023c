"""Line dedup by site spread.

A line's site spread is the number of distinct sources whose documents hold it. HyperLogLog
sketches per line hash are merged by aggregation; a line whose estimate lies within BAND of the
threshold is counted exactly instead. Lines on SITES or more sources are boilerplate and go from
every document, except one that would be left without words: such a document consists of shared lines
alone, which makes it a copy, for which near-dedup is the operator.

A line, and a text, can stand on any share of all rows; so joins on their hashes are made in SALTS parts of
the ids, of which a key gets a copy only where it has rows.

Lines are compared after trimming spaces; blank lines are never boilerplate. Defined cases: a
null text stays null and has 0 lines; a null source is a site of its own; repeated rows each get a
row; ids are only carried; columns with other names are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

SITES = 10
#: Relative half-width of the band that is counted exactly, about five times the sketch's error.
BAND = 0.1
LOG_K = 11
SALTS = 16


def _hash128(text: Column, name: str) -> list[Column]:
    return [F.xxhash64(text).alias(f"{name}x"), F.xxhash64(F.lit(1), text).alias(f"{name}y")]


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _salt(docs: DataFrame) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int") if "doc_id" in docs.columns else F.lit(0)


def line_index(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: hashes of its text (tx, ty) and of itself (kx, ky),
    its position, its site and salt. Line texts go no further."""
    split = docs.filter(F.col("text").isNotNull()).select("text", _salt(docs).alias("salt"), F.coalesce(F.xxhash64("source"), F.lit(0)).alias("site")).select(*_hash128(F.col("text"), "t"), "site", "salt", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = split.withColumn("line", F.trim("line")).filter("line <> ''")
    return trimmed.select("tx", "ty", "pos", "site", "salt", *_hash128(F.col("line"), "k"))


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys (kx, ky) of the lines found on `sites` or more sources, and the salts of their rows.

    Only lines on as many rows can be; the others get no sketch.
    """
    key = ["kx", "ky"]
    parts = lambda keys: keys.select(*key, F.explode(common.salts_of("salts", SALTS)).alias("salt"))
    often = lines.groupBy(*key).agg(F.count("*").alias("n"), common.salts_seen("salt").alias("salts")).filter(F.col("n") >= sites)
    seen = lines.join(parts(often), [*key, "salt"], "left_semi")
    sketched = seen.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"), common.salts_seen("salt").alias("salts"))
    sketched = common.written(sketched.filter(F.col("sites") >= sites * (1 - BAND)), "line-spread")
    clear = sketched.filter(F.col("sites") > sites * (1 + BAND)).select(*key, "salts")
    near = sketched.filter(F.col("sites") <= sites * (1 + BAND))
    pairs = lines.join(parts(near), [*key, "salt"], "left_semi").groupBy(*key, "site").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts"))
    exact = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.bit_or("salts").alias("salts")).filter(F.col("n") >= sites)
    found = common.written(parts(clear.unionByName(exact.select(*key, "salts"))), "line-boilerplate")
    common.drop_written(lines.sparkSession, sketched)
    return found


def marked(docs: DataFrame, sites: int = SITES, out: str = "line_dedup") -> DataFrame:
    """docs with a struct column `out`: n_lines, n_removed and the text that remains.

    What goes from a text depends on the text alone, so positions are looked up by its hash (for each
    salt that the text has) and joined back by it.
    """
    x, y, salt, gone_at, take = (common.free_name(docs, n) for n in ("x", "y", "salt", "gone", "take"))
    lines = common.written(line_index(docs), "line-index")
    gone = lines.join(spread_lines(lines, sites), ["kx", "ky", "salt"], "left_semi").groupBy("tx", "ty", "salt").agg(F.collect_set("pos").alias(gone_at))
    gone = gone.withColumnsRenamed({"tx": x, "ty": y, "salt": salt})
    keyed = docs.withColumns({x: F.xxhash64("text"), y: F.xxhash64(F.lit(1), "text"), salt: _salt(docs)})
    joined = keyed.join(gone, [x, y, salt], "left")
    split, at = F.split("text", "\n"), F.col(gone_at)
    hit_words = _words(F.array_join(F.filter(split, lambda line, i: F.array_contains(at, i)), "\n"))
    joined = joined.withColumn(take, F.when(at.isNull() | F.col("text").isNull(), False).otherwise(hit_words < _words(F.col("text"))))
    rest = F.when(F.col(take), F.array_join(F.filter(split, lambda line, i: ~F.array_contains(at, i)), "\n")).otherwise(F.col("text"))
    result = F.struct(
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col(take), F.size(at)).otherwise(0).cast("long").alias("n_removed"),
        rest.alias("text"),
    )
    return joined.withColumn(out, result).drop(x, y, salt, gone_at, take)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return marked(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("line_dedup.text", F.lit("")), 256).alias("text_sha256"))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the documents with their boilerplate lines removed, unless no
    words would remain; n_chars, where there is such a column, follows the text."""
    name = common.free_name(docs, "lines")
    out = marked(docs, out=name).withColumn("text", F.col(f"{name}.text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"{name}.n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(name)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), spread AS (
  SELECT trim(line, ' ') AS k FROM e WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= 10
), m AS (
  SELECT e.doc_id, e.line, e.i, s.k IS NOT NULL AS gone FROM e LEFT JOIN spread s ON trim(e.line, ' ') = s.k
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_gone, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone) AS hit,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS rest
  FROM m GROUP BY doc_id
), t AS (
  SELECT d.*, g.n_gone, g.rest, coalesce(g.n_gone > 0 AND len(regexp_extract_all(g.hit, '[^\x20\x09-\x0D]+')) < len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), false) AS take
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, CASE WHEN take THEN n_gone ELSE 0 END::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN take THEN coalesce(rest, '') ELSE text END, '')) AS text_sha256
FROM t
"""
