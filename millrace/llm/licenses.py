"""License scan by ordered signature rules, in DataFrame functions only.

The text is normalised to lower-case words with single spaces between them. Base phrases are placed
by plain string functions. The hand-written regexes of license_rules run only where their keyword is in
the text, and overlapping detections are resolved by level and interval containment in one sorted pass.

Defined cases: a null text counts as empty: 0 words, null first_word and last_word, empty labels,
score 0; texts are scanned whole; repeated rows each get a row; detections of one stretch and level all count;
other columns are never read.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.license_rules import rules

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LEVELS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_line(text: Column) -> Column:
    """Lower-case words (A-Z alone are lower-cased) with a space before, between and behind them."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much the faster; only these two characters would become ASCII letters by it
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    lower = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _groups() -> Column:
    """Array of (keyword, its rules) as a constant, which the optimizer folds."""
    by = defaultdict(list)
    for label, level, keyword, regex in rules():
        by[keyword].append({"label": label, "level": level, "regex": regex})
    kind = "array<struct<keyword: string, rules: array<struct<label: string, level: int, regex: string>>>>"
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": r} for k, r in by.items()])), kind)


def _gate() -> str:
    """One regex for any keyword at a word's start, branched by first letter."""
    by = defaultdict(set)
    for _, _, keyword, _ in rules():
        by[keyword[0]].add(keyword[1:])
    return " (?:" + "|".join(c + "(?:" + "|".join(sorted(rest)) + ")" for c, rest in sorted(by.items())) + ")"


#: Matches whose places are added up at a time; it bounds the arrays that grow by one.
CHUNK = 256


def _places(line: Column, rule: Column) -> Column:
    """All matches of the rule as (start, -end, level, label): the lengths between and of the matches, added
    up in chunks, each from where the one before ends."""
    between, found = F.split(line, rule["regex"]), F.regexp_extract_all(line, rule["regex"], F.lit(0))
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    chunk = lambda all_, i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + x["hit"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    def spans(all_):
        which = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        sums = F.transform(which, lambda i: F.aggregate(chunk(all_, i), F.lit(0), lambda n, x: n + x["gap"] + x["hit"]))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(which, starts, lambda i, at: F.aggregate(chunk(all_, i), F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    # a lambda's argument is evaluated once, however often it stands in the body
    whole = F.element_at(F.transform(F.array(sizes), lambda all_: F.when(F.size(all_) > 0, spans(all_)).otherwise(none)), 1)
    return F.transform(whole, lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), (-rule["level"]).alias("level"), rule["label"].alias("label")))


def _surviving(hits: Column) -> Column:
    """(labels, best level) of the detections that lie in none of a higher level and in no longer
    one of their own. Sorted by start, longer first, a detection lies in an earlier one that ends
    no sooner; the furthest end of each level so far is all that has to be kept."""
    acc = F.struct(*[F.lit(0).alias(f"m{k}") for k in range(1, LEVELS + 1)], F.lit(-1).alias("s"), F.lit(0).alias("e"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(a, h):
        end, level = -h["e"], -h["level"]
        inside = F.lit(False)
        for k in range(1, LEVELS + 1):
            higher = (level < k) & (a[f"m{k}"] >= end)
            # of its own level, and not the very same stretch as the last one
            same = (level == k) & (a[f"m{k}"] >= end) & ~((a["s"] == h["s"]) & (a["e"] == end))
            inside = inside | higher | same
        reach = [F.when(level == k, F.greatest(a[f"m{k}"], end)).otherwise(a[f"m{k}"]).alias(f"m{k}") for k in range(1, LEVELS + 1)]
        return F.struct(*reach, h["s"].alias("s"), end.alias("e"), F.when(inside, a["labels"]).otherwise(F.array_union(a["labels"], F.array(h["label"]))).alias("labels"), F.when(inside, a["best"]).otherwise(F.greatest(a["best"], level)).alias("best"))

    return F.aggregate(hits, acc, step, lambda a: F.struct(a["labels"].alias("labels"), a["best"].alias("best")))


def scanned(docs: DataFrame, out: str = "license") -> DataFrame:
    """docs with a struct column `out` of the scan's results."""
    line, held = common.free_name(docs, "line"), common.free_name(docs, "found")
    d = docs.withColumn(line, words_line(F.col("text")))
    t = F.col(line)
    n_words = F.when(t == "  ", 0).otherwise(_spaces(t) - 1).cast("long")
    has = {p: F.contains(t, F.lit(f" {p} ")) for p in BASE}
    n_base = sum((F.when(has[p], F.regexp_count(t, F.lit(f" {p}(?= )"))).otherwise(0) for p in BASE), F.lit(0)).cast("long")
    first = F.least(*[F.when(has[p], _spaces(F.substring_index(t, f" {p} ", 1))).cast("long") for p in BASE])
    last = F.greatest(*[F.when(has[p], _spaces(t) - 1 - _spaces(F.substring_index(t, f" {p} ", -1)) - len(p.split())).cast("long") for p in BASE])
    base = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in BASE.items()]))
    gate = F.rlike(t, F.lit(_gate()))
    chosen = F.flatten(F.transform(F.filter(_groups(), lambda g: F.contains(t, F.concat(F.lit(" "), g["keyword"]))), lambda g: g["rules"]))
    hits = F.sort_array(F.flatten(F.transform(F.filter(chosen, lambda r: F.rlike(t, r["regex"])), lambda r: _places(t, r))))
    d = d.withColumn(held, F.when(gate, _surviving(hits)))
    found = F.coalesce(F.col(held)["labels"], F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, found))
    best = F.greatest(F.coalesce(F.col(held)["best"], F.lit(0)), F.when(F.size(base) > 0, 2).otherwise(0))
    result = F.struct(
        n_words.alias("n_words"), n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (best / F.lit(float(LEVELS))).cast("double").alias("score"),
    )
    return d.withColumn(out, result).drop(line, held)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned(docs).select("doc_id", "license.*")
