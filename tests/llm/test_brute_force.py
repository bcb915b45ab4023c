"""The registered queries against independent brute force, whole tables at a time, and held-out rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import bpe, common, decontam, html, license_rules, licenses, quality, setjoin, simhash, toxicity
from tests.llm.test_operators import edit_distance
from tests.oracle import DATA

SMALL = "/root/testdata/sf0.001"


def folder(tmp_path, **frames) -> str:
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- 1 decontamination


def test_op1_query_is_brute_force(spark, tmp_path):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{i}", " ".join(rng.choice(words, rng.integers(1, 14)))) for i in range(12)] + [(None, "w1 w2"), ("none", None), ("marks", "?!")]
    docs = []
    for i in range(60):
        text = list(rng.choice(words, rng.integers(0, 30)))
        if i % 3 == 0:
            text += items[i % 12][1].split()
        docs.append((i if i % 7 else None, " ".join(text) if i % 11 else None))
    where = folder(tmp_path, documents=spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark=spark.createDataFrame(items, "item_id string, text string"))
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontam.op1_decontamination(spark, where).collect())
    want = Counter()
    for doc_id, text in docs:
        for item_id, item in items:
            m = (item or "").replace("?!", "").split()
            if item_id is not None and m and (d := edit_distance(m, (text or "").split())) <= len(m) // 6:
                want[doc_id, item_id, d] += 1
    assert got == want and want


# --- 4 quality


def test_quality_of_labels_not_learned_from(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = common.crc_mod("doc_id", 3) == 0
    model = quality.fit_on_labels(docs, labels.filter(~held))
    scored = quality.scored(docs.select("doc_id", "text"), model, out="verdict").join(labels.filter(held), "doc_id")
    rows = scored.filter("not verdict.base_failed").select("verdict.kept", F.col("quality").alias("label")).collect()
    assert np.mean([r.kept == bool(r.label) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.label]) > 0.97


def test_flat_trees_are_a_naive_walk():
    rng = np.random.default_rng(22)
    x = rng.normal(size=(300, 4))
    model = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), monotone=(0, 0, 0, 0), trees=20)
    for row, p in zip(x, model.score(x)):
        total = model.bias
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_takes_any_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), (None, "z")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("a", 0), (None, 1), ("c", None)], "doc_id string, quality int")
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert toxicity.scored(docs, toxicity.fit_on_labels(docs, labels.withColumnRenamed("quality", "toxic"))).count() == 3
    assert quality.scored(docs.limit(0), quality.fit_on_labels(docs.limit(0), labels.limit(0))).count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    one = common.labelled_texts(docs, labels, "quality", 100).orderBy("id").collect()
    assert one == common.labelled_texts(docs.repartition(13), labels.repartition(7), "quality", 100).orderBy("id").collect() and len(one) == 100


# --- 5 html

ARTICLE = "<article><h1>The head</h1><p>One sentence of the text stands here. Another one follows it.</p></article>"
MAIN = "The head\nOne sentence of the text stands here. Another one follows it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=x><body><header><h1>Site</h1></header>{ARTICLE}</body>",  # no end of the head
        f"<html><head><title>T</title><header>Site name</header>{ARTICLE}",  # nor a body
        f"<body><svg width=3>{ARTICLE}",
        f"<body><video>{ARTICLE}<select>",
        f"<body>{ARTICLE}<article class='comment'><p>I do not agree with any of this, said a reader.</p></article>",
        f"<body>{ARTICLE[:-10]}<article class='reply'><p>I do not agree with any of this, said a reader.</p></article></article>",
        "<body><nav>" + "<div>" * 800 + "<p>Menu text of many words that looks like a sentence.</p>" + "</div>" * 800 + f"</nav>{ARTICLE}",
        "<body>" + "<div>" * 5000 + ARTICLE,
        f"<body><TITLE>T</TITLE ><titlebar>{ARTICLE}</titlebar><aside><p>See also these other pages of ours.</p></aside>",
        f"<body><form><p>Please write your name and address here.</p></form>{ARTICLE}<script>var x = '<p>never';",
    ],
)
def test_html_odd_pages(page):
    assert html.extract(page) == MAIN


def test_fitted_extraction_is_the_article(spark):
    pages = common.table(spark, DATA, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in html.op5_html_text(spark, DATA).collect()}
    from html import unescape

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        cut = (" ".join(unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body))
        text = "\n".join(x for x in cut if x)
        assert got[r.page_id] == (text, len(text))


def test_cut_mends_what_the_classifier_alone_gets_wrong(spark):
    """Pages without landmarks, some of whose paragraphs are a single link."""
    pages = common.table(spark, DATA, "pages")
    weights = html.fit_on_pages(pages)
    flipped = mended = 0
    for r in pages.collect():
        head, body, tail = re.match(r"(.*?)<article>(.*?)</article>(.*)", r.html, re.S).groups()
        turn = iter(range(10**6))
        body = re.sub(r"<p>((?:(?!<p>).)*?)</p>", lambda m: f'<p><a href="/x">{m[1].rstrip(".")}</a></p>' if next(turn) % 4 == 1 and len(m[1]) < 120 else m[0], body)
        found = html.blocks(f"{head}<div>{body}</div>{tail}")
        prices = html.prices(found, weights)
        for b, price, label in zip(found, prices, html.min_cut(prices, html.smoothness(found))):
            if (price > 0) != label:
                flipped += 1
                mended += label == (b.tag not in ("li", "footer") and not b.apart)
    assert flipped >= 20 and mended == flipped


def test_html_tables(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", ARTICLE), (4, None, ARTICLE * 3), (4, None, ARTICLE * 3), (5, "u", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("main", F.lit(1))
    got = html.extracted(pages.drop("main"), html.fit_on_pages(pages)).select("page_id", "text", "main.n_chars").collect()
    assert len(got) == 6 and {r.text for r in got} == {"clash"} and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0]
    assert html.extracted(pages.limit(0), html.fit_on_pages(pages.limit(0)), out="m").count() == 0
    assert html.extract("<p>" + "<div>Some words here.</div>" * 3000).count("\n") == 2999


# --- 6 licences

_RULES = [(label, level, keyword, re.compile(regex)) for label, level, keyword, regex in license_rules.rules()]
_BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for phrase, label in _BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    line = " " + " ".join(words) + " "
    hits = [(m.start(), m.end(), level, label) for label, level, keyword, regex in _RULES if " " + keyword in line for m in regex.finditer(line)]
    over = lambda g, h: g[0] <= h[0] and g[1] >= h[1] and (g[2] > h[2] or g[2] == h[2] and g[:2] != h[:2])
    left = [h for h in hits if not any(over(g, h) for g in hits)]
    labels = sorted(base | {h[3] for h in left})
    score = max([h[2] for h in left] + [2 * bool(base)], default=0) / 4
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score


def test_op6_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in common.table(spark, DATA, "documents").collect()}
    for r in licenses.op6_license_scan(spark, DATA).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_license(texts[r.doc_id]), r.doc_id


def example(regex: str) -> str:
    """A text that a rule must find: its regex with options taken and classes resolved by their first character."""
    from re import _parser as parser

    def say(items) -> str:
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "ANY":
                out += "x"
            elif name == "IN":
                kind, value = arg[0]
                out += chr(value if str(kind) == "LITERAL" else value[0])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += say(arg[2]) * max(1, arg[0])
            elif name == "SUBPATTERN":
                out += say(arg[3])
            elif name == "BRANCH":
                out += say(arg[1][0])
        return out

    return say(parser.parse(regex.removesuffix("(?= )")))


def test_every_license_rule_finds_its_example(spark):
    rules = license_rules.rules()
    docs = [(i, example(regex)) for i, (_, _, _, regex) in enumerate(rules)]
    docs += [(1000, "Copyright (c) 2019, 2020 Someone"), (1001, "is licensed under the terms of a contract"), (1002, "gpl " * 20_000), (1003, "Mit License. " * 700 + "cc by-sa 4.0")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(docs, "doc_id bigint, text string")).select("doc_id", "text", "license.*").collect()}
    for i, text in docs:
        r = got[i]
        if i != 1002:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_license(text), text
        if i < 1000:
            label, level, keyword, regex = rules[i]
            line = " " + " ".join(text.split()) + " "
            assert " " + keyword in line and re.search(regex, line), (label, text)
            assert r.labels, (label, text)
    assert "copyright" in got[1000].labels and "licensed-unknown" in got[1001].labels and got[1002].labels == "gpl"


# --- 8 simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return "0" * 16
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_op8_query_is_brute_force(spark, tmp_path):
    texts = [r.text for r in common.table(spark, SMALL, "documents").collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " \n"), (902, "ABC"), (903, "abc"), (904, "abc"), (None, "abc")]
    where = folder(tmp_path, documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = simhash.op8_simhash_near_dedup(spark, where).collect()
    assert len(got) == len(rows)
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert all(r.fingerprint == want[r.doc_id] for r in got)
    value = {i: int(f, 16) for i, f in want.items() if i is not None}
    root = dict.fromkeys(value)
    for i in sorted(value):
        if root[i] is None:
            todo = [i]
            while todo:
                a = todo.pop()
                if root[a] is None:
                    root[a] = i
                    todo += [b for b in value if root[b] is None and (value[a] ^ value[b]).bit_count() <= 4]
    assert all(r.component_id == (root[r.doc_id] if r.doc_id is not None else root[902]) for r in got)


def test_tally_counts_shared_positional_bytes():
    rng = np.random.default_rng(23)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.where(rng.random((400, 8)) < 0.5, a.view(np.uint8).reshape(-1, 8), rng.integers(0, 256, (400, 8), dtype=np.uint8)).astype(np.uint8).reshape(-1).view(np.uint64)
    want = [(x == y).sum() for x, y in zip(a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8))]
    assert simhash.tally(a ^ b).tolist() == want
    # a pair within reach always gets the guaranteed minimum
    for _ in range(200):
        flips = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert simhash.tally(np.array([flips], np.uint64))[0] >= simhash.MATCHES


def test_sql_tally_is_the_tally(spark):
    rng = np.random.default_rng(24)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63, (50, 2))] + [(5, 5), (0, -1), (1, 257)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", simhash._tally(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == simhash.tally(np.array([r.a ^ r.b], np.int64).view(np.uint64))[0] for r in got)


def test_every_pair_of_positions_meets_and_keys_are_a_smallest_set():
    from itertools import combinations

    assert len(simhash.SUBSETS) == 20
    assert all(any(set(t) <= set(four) for t in simhash.SUBSETS) for four in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [3, 40])
def test_dense_lists_are_split_without_losing_links(spark, limit, monkeypatch):
    """A list of hundreds of fingerprints that share five bytes, in clusters and chains."""
    monkeypatch.setattr(simhash, "KEY_LIMIT", limit)
    monkeypatch.setattr(simhash, "FREE_BITS", 8)
    rng = np.random.default_rng(25)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ int(x) for x in rng.integers(0, 2**24, 250)}
    for f in list(fps)[:60]:
        fps.add(f ^ sum(1 << int(i) for i in rng.choice(62, 4, replace=False)))
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()

    def groups(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(f) for f in fps]

    assert groups([(r.a, r.b) for r in edges]) == groups([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4])


def test_keep_one_goes_by_text_not_by_id(spark):
    long = [f"{x}{i}" for x in "ab" for i in range(40)]
    near = [*long[:-1], "other"]
    rows = [(1, "one text of its own here"), (1, "a second text stands apart"), (1, "and this is the third of them"), (None, " ".join(long)), (None, " ".join(near)), (7, "twice the same row"), (7, "twice the same row")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__MILLRACE_id", F.lit("kept")).withColumn("__millrace_text", F.lit(2))
    got = simhash.keep_one(docs)
    texts = sorted(r.text for r in got.collect())
    assert got.columns == docs.columns and len(texts) == 5 and texts.count("twice the same row") == 1
    assert sum(t.startswith("a0 a1") for t in texts) == 1


def test_keep_one_leaves_only_what_its_result_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 20 + i % 6], f"end{i % 9}"])) for i in range(30)], "doc_id bigint, text string")
    kept = simhash.keep_one(docs)
    assert 0 < kept.count() < 30
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"near-dedup-chosen"}


def test_a_passage_in_a_share_of_all_texts_makes_no_large_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(setjoin, "SAMPLE_TEXTS", 20)
    found = []
    monkeypatch.setattr(common, "written", lambda df, label, put=common.written: (out := put(df, label), label == "setjoin-met" and found.append(out.count()))[0])
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 50_000, 60)), *(passage if i % 15 == 0 else [])])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.keep_one(docs).count() == 1500
    # each of the 100 texts has 18 or 19 prefix members, over a quarter of its shingles are the passage's
    assert found and found[0] <= 100


def test_keep_one_links_by_fingerprints_first(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [" ".join([*base[: 200 - cut], *(f"x{i}" for i in rng.integers(0, 5000, cut))]) for cut in (0, 1, 3, 8, 40)]
    short = ["a b", "a c", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts + short)), "doc_id bigint, text string")
    entries = setjoin.described(docs, 5, simhash.majority).withColumn("first_id", F.col("doc_id"))
    rows = entries.collect()
    assert all(r.sim % 2**64 == simhash.fingerprint(t, 5) % 2**64 for t, r in zip(texts + short, sorted(rows, key=lambda r: r.doc_id)))
    sets = {r.fp: set(setjoin.shingles(setjoin.words_of(t), 5).tolist()) for t, r in zip(texts + short, sorted(rows, key=lambda r: r.doc_id))}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    close = [(a.fp, b.fp) for i, a in enumerate(rows) for b in rows[i + 1 :] if ((a.sim ^ b.sim) % 2**64).bit_count() <= 4]
    pairs = [(r.a, r.b) for r in simhash.likely(entries).collect()]

    def groups(pairs):
        root = {f: f for f in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert len(close) > 12 and groups(pairs) == groups(close)
    # without prefixes the exact join finds nothing: what is left is what the fingerprints found, by the sets
    bare = entries.withColumn("prefix", F.array().cast("array<bigint>"))
    got = [(r.a, r.b) for r in setjoin.links(docs, bare, 5, simhash.likely(entries)).collect()]
    assert got and set(map(frozenset, got)) == {frozenset(p) for p in pairs if alike(*p)}
    # and pairs within those components aren't formed again
    tried = []
    monkeypatch.setattr(setjoin, "verified", lambda docs, entries, pairs, size, f=setjoin.verified: (tried.append(pairs.collect()), f(docs, entries, pairs, size))[1])
    all_links = [(r.a, r.b) for r in setjoin.links(docs, entries, 5, simhash.likely(entries)).collect()]
    assert groups(all_links) == groups([(a, b) for a in sets for b in sets if a < b and alike(a, b)])
    settled = groups(got)
    assert tried[1] and all(settled[r.a] != settled[r.b] for r in tried[1])


# --- 9 toxicity


def test_toxicity_learns_a_pair_from_labels(spark):
    rng = np.random.default_rng(26)
    filler = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(1600):
        insult, group = rng.random(2) < 0.5
        rows.append((i, " ".join([*rng.choice(filler, 6), *(["dolt"] if insult else []), *(["folk"] if group else [])]), int(insult and group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit_on_labels(docs, labels.filter("doc_id < 1200"))
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).select("doc_id", "toxicity.predicted").collect()}
    assert np.mean([got[i] == y for i, _, y in rows[1200:]]) > 0.97
    model.factor[:] = 0
    model.square[:] = 0
    assert model.factor.shape[0] >= 2


# --- 10 BPE


def test_op10_query_is_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.tokenizer_path())
    theirs.no_truncation()
    theirs.no_padding()
    texts = [r.text for r in common.table(spark, SMALL, "documents").collect()]
    texts += [None, "", " ", "\n\n", "a  b", "tab\there", "<|endoftext|> x<|endoftext|>", "日本 🙂 naïve\r\nend ", "z" * 5000, "ab" * 3000, "word " * 300_000, "é" * 700]
    where = folder(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_bpe(spark, where).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))), i


def test_most_pieces_come_from_the_transducer(spark):
    docs = common.table(spark, DATA, "documents")
    vocabulary = bpe.Vocabulary(bpe.tokenizer_path())
    codec = bpe.Codec(vocabulary, bpe.lexicon_of(bpe.frequent_words(docs), vocabulary))
    texts = [r.text for r in docs.collect()]
    codec.digests(texts)
    words = sum(len((t or "").split()) for t in texts)
    assert codec.looked_up >= words and codec.found > 0.7 * codec.looked_up


def test_merging_many_words_is_merging_each(spark):
    vocabulary = bpe.Vocabulary(bpe.tokenizer_path())
    rng = np.random.default_rng(27)
    words = ["".join(rng.choice(list("aeinrst' é日"), rng.integers(1, 30))).encode() for _ in range(400)]
    ids, counts = vocabulary.merged(words)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(p.tolist() == vocabulary._merged_alone(w) for p, w in zip(parts, words))


# --- 7 and the pipeline


def test_op7_keeps_a_source_conversation_apart_from_its_own(spark, tmp_path):
    from millrace.llm import chat

    rows = [(-1, 0, "user", "mine"), (-1, 1, "assistant", "</s>"), (3, None, None, None)]
    where = folder(tmp_path, conversations=spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted((r.conv_id, r.n_turns, r.loss_chars, r.identical) for r in chat.op7_chat_format(spark, where).collect())
    assert got == [(-1, 2, 4, True), (-1, 2, 21, True), (3, 1, 0, True)]


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    tables = {t: common.table(spark, SMALL, t).limit(0) for t in ("documents", "labels", "benchmark", "conversations", "pages")}
    where = folder(tmp_path, **tables)
    out = corpus_pipeline.run(spark, where)
    assert out.count() == 0 and out.columns[: len(tables["documents"].columns)] == tables["documents"].columns
    from millrace.llm import queries

    for name, query in queries.queries().items():
        if name not in ("pipeline", "op7_chat_format"):
            assert query(spark, where).count() == 0, name
    assert [r.conv_id for r in queries.queries()["op7_chat_format"](spark, where).collect()] == [-1]


def test_stages_leave_clashing_columns_alone(spark):
    docs = common.table(spark, SMALL, "documents").select("*", *[F.lit(i).alias(f"__millrace_{x}") for i, x in enumerate(("quality", "lines", "x", "take", "id", "leaks", "line"))])
    import corpus_pipeline

    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SMALL)
        assert out.columns == docs.columns
    assert out.select("__millrace_leaks", "__millrace_id").distinct().collect() == [(5, 4)]


def test_small_tables_are_dealt_out_over_the_cores(spark):
    documents = common.table(spark, "/root/testdata/sf0.1", "documents")
    assert documents.rdd.getNumPartitions() < 8 == common.spread(documents).rdd.getNumPartitions()
    region = common.table(spark, SMALL, "region")
    assert common.spread(region).rdd.getNumPartitions() == region.rdd.getNumPartitions()
