"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is a sequence of turns  `<s>[INST]` role `[/INST]` text `</s>`. It is rendered as it stands
and reparsed by the deterministic parser (cut at `</s>`, then at `[/INST]`, then unescape). If the
turns that come back are not the source's, or a text holds a control string, the texts that conflict are escaped and the conversation
is rendered again: a tilde goes in after the bracket of every control string, however many tildes are there
already, and the parser takes one off. Escaping is one-to-one and leaves no control string, so one
round of it always suffices; the `identical` column says that the final output was checked.

Defined cases: null text or role is the empty string; rows are ordered by turn (null first), then
role and text, so repeated rows stay side by side; rows with a null conv_id are one conversation; a
conversation -1 of the source stands beside op7's own; an empty table gives no rows; other columns are never read. The digest of a conversation needs its
whole text in order, so a conversation (alone) must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(~*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])~(~*)(/?s>|/?INST\])"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>."""
    parts = F.split(formatted, r"\Q" + CLOSE + r"\E")
    bodies = F.transform(F.filter(parts, lambda p: p.startswith(OPEN)), lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    role = lambda b: F.substring_index(b, MIDDLE, 1)
    return F.transform(bodies, lambda b: F.struct(unescape(role(b)).alias("role"), unescape(F.substring(b, F.char_length(role(b)) + len(MIDDLE) + 1, F.lit(2**31 - 1))).alias("text")))


def conversations(rows: DataFrame, *also: str) -> DataFrame:
    """One row for each conv_id (and each value of the columns `also`): turns, in order, as array<struct<role, text>>."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id", *also).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted(convs: DataFrame) -> DataFrame:
    """convs (conv_id, turns) with formatted, escaped (rows that needed it), parsed and identical."""
    plain = convs.withColumn("formatted", render(F.col("turns")))
    stray = F.exists("turns", lambda t: F.rlike(t["role"], F.lit(_CONTROL)) | F.rlike(t["text"], F.lit(_CONTROL)))
    plain = plain.withColumn("escaped", stray | ~(parse(F.col("formatted")) == F.col("turns")))
    safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    out = plain.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("formatted")))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    return out.withColumn("identical", F.col("parsed") == F.col("turns"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in rows.schema}
    probe = spark.range(1).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast(kinds["turn"]).alias("turn"), F.lit("user").alias("role"), F.lit(PROBE).alias("text")), F.struct(F.lit(1).cast(kinds["turn"]).alias("turn"), F.lit("assistant").alias("role"), F.lit(PROBE).alias("text")))).alias("t"),
    ).select("conv_id", "t.*")
    both = rows.withColumn("probe", F.lit(False)).unionByName(probe.withColumn("probe", F.lit(True)))
    done = formatted(conversations(both, "probe"))
    digest = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', true UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', true
), e AS (
  SELECT *, regexp_matches(role || chr(10) || text, '[<\[]~*(/?s>|/?INST\])') AS bad,
    regexp_replace(role, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g') AS erole, regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g') AS etext
  FROM rows_
), c AS (
  SELECT conv_id, count(*) AS n, bool_or(bad) AS bad,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS digest,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(erole) + length(etext) + 20) AS elen, sum(length(role) + length(text) + 20) AS plen
  FROM e GROUP BY conv_id, probe
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(digest) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (CASE WHEN bad THEN elen ELSE plen END)::BIGINT AS formatted_chars, bad AS escaped, true AS identical
FROM c
"""
