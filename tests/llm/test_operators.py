"""Each operator against brute force, an exact round trip or held-out rows, and its edge cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, common, decontam, html, langid, licenses, linededup, quality, queries, setjoin, simhash, toxicity
from tests.oracle import DATA, connect, same

SMALL = "/root/testdata/sf0.001"
EDGES = [None, "", " ", "\n\n", "a", "a", "x " * 40_000, "É ñ ß 日本 🙂", "\x00\x85\xa0", "The MIT License. cc by cc by"]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key string, id bigint, word string, line string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "s", None, "f", "k", 1, "w", "l") for i, t in enumerate(EDGES)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_chat_format"])
def test_sql(spark, name):
    con = connect()
    same(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name])


# --- 1 decontamination


def edit_distance(pattern, text):
    """Least distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p, t = ([chr(97 + c) for c in rng.integers(0, 4, n)] for n in (rng.integers(1, 12), rng.integers(0, 30)))
        masks = {}
        for i, w in enumerate(p):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontam.myers(masks, len(p), t)[0] == edit_distance(p, t)


def test_decontamination_is_brute_force():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(12)]
    matcher = decontam.Matcher(items)
    for _ in range(60):
        words = list(rng.choice(vocabulary, 40))
        item = items[rng.integers(12)][1].split()
        for _ in range(rng.integers(0, 6)):
            at = rng.integers(len(item))
            item = item[:at] + [["zz"], [], ["yy", item[at]]][rng.integers(3)] + item[at + 1 :]
        words[10:10] = item
        want = {i for i, t in items if edit_distance(t.split(), words) <= len(t.split()) // 6}
        assert {f["item_id"] for f in matcher.find(", ".join(words).upper())} == want


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "one two three four five six"), (2, "one two three four five six")], "item_id bigint, text string")
    for block in decontam.blocks(bench):
        assert decontam.matched(edges, block).count() == len(EDGES)
    assert decontam.without_leaks(edges, bench).count() == len(EDGES)
    assert decontam.without_leaks(empty, bench).count() == 0


# --- 2 line dedup


def test_line_dedup_edges(spark, edges, empty):
    out = linededup.without_boilerplate(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES)
    assert linededup.marked(empty).count() == 0
    rows = [(i, f"shared line\nown text of document number {i}\n\nmore own text {i}", f"s{i}") for i in range(12)] + [(99, None, None)]
    out = {r[0]: r[1] for r in linededup.without_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("doc_id", "text").collect()}
    assert out[3] == "own text of document number 3\n\nmore own text 3" and out[99] is None


def test_pipeline_line_dedup_spares_only_whole_copies(spark):
    shared = " ".join(f"header{i}" for i in range(70))
    rows = [(i, f"{shared}\n" + " ".join(f"own{i}x{k}" for k in range(60)), f"s{i}") for i in range(12)] + [(99, shared, "t")]
    out = {r[0]: r[1] for r in linededup.without_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("doc_id", "text").collect()}
    assert all(out[i] == t.split("\n")[1] for i, t, _ in rows[:12]) and out[99] == shared


# --- 3 language


def test_language_held_out(spark):
    rows = langid.op3_language_id(spark, DATA).join(common.table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edges, empty):
    model = langid.fit_on_documents(edges)
    got = langid.scored(edges, model).select("text", "language.*").collect()
    assert [r.lang_pred for r in got if not r.text or not any(map(str.isalpha, r.text))] == ["und"] * 5
    assert langid.scored(empty, langid.fit_on_documents(empty)).count() == 0


def test_presence_in_pieces_is_presence():
    text = "ab cd é " * 40_000
    a, b = np.zeros(1 << langid.BITS), np.zeros(1 << langid.BITS)
    langid.presence(text, a)
    langid.presence("ab cd é " * 10, b)
    assert (a == b).all()


# --- 4 quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base_is_brute_force(spark, edges):
    texts = [r[0] for r in common.table(spark, SMALL, "documents").select("text").collect()] + EDGES
    for t in texts:
        assert quality.statistics(t)[0] == brute_quality(t)
    assert quality.keep_good(edges, spark.createDataFrame([], "doc_id bigint, quality int")).columns == edges.columns


def test_trees_are_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + 0.3 * rng.normal(size=600)) < 0).astype(float)
    model = quality.fit(x, y, monotone=(-1, 0, 0), trees=30)
    grid = np.repeat(rng.normal(size=(1, 3)), 50, axis=0)
    grid[:, 0] = np.linspace(-3, 3, 50)
    assert (np.diff(model.score(grid)) <= 1e-12).all() and np.mean((model.score(x) > 0.5) == (y > 0)) > 0.85


def test_quality_verdicts(spark):
    rows = quality.op4_quality_rules(spark, DATA).join(common.table(spark, DATA, "labels"), "doc_id").collect()
    assert all(not r.kept for r in rows if r.base_failed)
    assert np.mean([r.kept == bool(r.quality) for r in rows if not r.base_failed]) > 0.95


# --- 5 html


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; tail</h1><p>One  two<br>three.<p><b>Four</b> five six seven.</article><div class="comments"><p>I disagree with this text entirely.</p></div><footer>&copy; 2020 someone</footer><script>x("<p>no</p>")</script>'
    assert html.extract(page) == "Head & tail\nOne two three.\nFour five six seven."
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<a" * 1000, "<p>" * 2000):
        assert isinstance(html.extract(odd), str)


def test_min_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        t = rng.normal(size=n).tolist()
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12)) if a != b]
        cost = lambda lab: sum(max(-x, 0) if s else max(x, 0) for x, s in zip(t, lab)) + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.min_cut(t, edges)) - best) < 1e-6


# --- 6 licences


def test_license_scan(spark, edges, empty):
    text = "Licensed under the Apache License, Version 2.0. GNU General Public License, version 3 or later. cc by cc by-sa 4.0, All Rights Reserved"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    one, two, three = (r.license for r in licenses.scanned(docs).orderBy("doc_id").collect())
    assert one.base_labels == "cc-by,gpl,reserved" and one.n_base == 4 and (one.first_word, one.last_word) == (9, 23)
    assert {"apache-2.0", "gpl-3.0", "cc-by-sa-4.0"} <= set(one.labels.split(",")) and "apache" not in one.labels.split(",")
    assert (two.n_words, two.first_word, two.labels, two.score) == (0, None, "", 0.0) and three == two
    assert licenses.scanned(edges).count() == len(EDGES) and licenses.scanned(empty).count() == 0


def test_license_rules_compile():
    from millrace.llm.license_rules import rules

    assert len(rules()) > 200
    for label, level, keyword, regex in rules():
        assert re.compile(regex) and 1 <= level <= licenses.LEVELS and keyword


# --- 7 chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<s>", "<~s>", "[~~/INST]", "<", "[INST", None, "", "</s></s>", "é🙂\n"]
    rows = [(i // 3, i % 3 if i % 4 else None, ["user", "assistant", None, "[INST]"][i % 4], t, "x") for i, t in enumerate(odd * 2)] + [(None, 0, "user", "hi", "x")] * 2
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string"))
    got = chat.formatted(convs).collect()
    assert all(r.identical for r in got) and any(r.escaped for r in got) and not all(r.escaped for r in got)
    for r in got:
        assert r.formatted.count(chat.CLOSE) == len(r.turns) == r.formatted.count(chat.OPEN)


# --- 8 simhash


def test_subsets_cover_every_pair_in_reach():
    rng = np.random.default_rng(6)
    for _ in range(300):
        changed = set((rng.choice(64, 4, replace=False) // 8).tolist())
        assert any(not changed & set(s) for s in simhash.SUBSETS)


def test_star_links_are_brute_force():
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds] + [seeds ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 60, (30, 2))]))

    def groups(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(b)] = find(a)
        return Counter(tuple(sorted(x for x in root if find(x) == r)) for r in {find(x) for x in root})

    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4]
    got = [(int(a) % 2**64, int(b) % 2**64) for a, b in zip(*simhash.star_links(fps.view(np.int64)))]
    assert groups(got) == groups(near)


@pytest.mark.parametrize("limit", [simhash.KEY_LIMIT, 2])
def test_near_dedup_is_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_LIMIT", limit)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_near_dedup(spark, SMALL).collect()}
    fp = {k: int(v[0], 16) for k, v in got.items()}
    root = {k: k for k in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and root[a] > root[b]:
                    root[a], changed = root[b], True
    assert {k: v[1] for k, v in got.items()} == root


def test_near_dedup_edges(edges, empty):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("a") == 1 and sum(not (t or "").split() for t in texts) <= 2
    assert simhash.keep_one(empty).count() == 0


def jaccard_groups(rows):
    """The smallest id of each group of (doc_id, text) linked at Jaccard 0.8 or more, pair by pair."""
    shingles = lambda t: frozenset(tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(len(w) - 4, 1)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] > root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    return set(root.values())


@pytest.mark.parametrize("limit", [setjoin.GROUP_LIMIT, 2])
def test_pipeline_near_dedup_is_brute_force_jaccard(spark, limit, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP_LIMIT", limit)
    rng = np.random.default_rng(11)
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = ["shared", "header", "of", "all", "these", "texts", *rng.choice(words, rng.integers(3, 150))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == jaccard_groups(rows) and 25 <= len(got) < len(rows)


# --- 9 toxicity


def test_toxicity_held_out(spark):
    rows = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hits, flagged, toxic = (sum(f(r) for r in held) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert hits / flagged > 0.97 and hits / toxic > 0.85


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_on_labels(edges, labels)
    assert toxicity.scored(edges, model).filter("toxicity.score between 0 and 1").count() == len(EDGES)
    assert toxicity.scored(empty, toxicity.fit_on_labels(empty, labels)).count() == 0


@pytest.mark.parametrize("insult", ["", "insulting"])
def test_toxicity_of_few_rows(spark, insult):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join([insult * (i < 8), *rng.choice(["apple", "river", "stone", "cloud", "table"], 3)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_on_labels(docs, docs.select("doc_id", (F.col("doc_id") < 8).cast("int").alias("toxic")))
    flagged = {r.doc_id for r in toxicity.scored(docs, model).filter("toxicity.predicted = 1").collect()}
    assert flagged == (set(range(8)) if insult else set())
    assert model.score(["", None]).max() < toxicity.CUT


def test_machine_learns_a_pair():
    rng = np.random.default_rng(8)
    x = (rng.random((800, 6)) < 0.5).astype(float)
    y = x[:, 0] * x[:, 1]
    model = toxicity.fit(x, y, np.arange(6))
    linear = x @ model.weight + model.bias
    v = x @ model.factor
    margin = linear + 0.5 * ((v**2).sum(axis=1) - x @ model.square)
    assert np.mean((margin > 0) == (y > 0)) > 0.98


# --- 10 BPE


def test_bpe_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    theirs, vocabulary = Tokenizer.from_file(path), bpe.Vocabulary(path)
    words = ["the", "and", "of,", "don't", "é", "日本", "naïve"]
    codec = bpe.Codec(vocabulary, bpe.lexicon_of(words, vocabulary))
    rng = np.random.default_rng(9)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "a", "Zé", "'s", "'ll", "12", "²", "!", "<|endoftext|>", "日本", "🙂", " the", "don't", "Ⅷ", "\x00"]
    for _ in range(3000):
        s = "".join(rng.choice(parts, rng.integers(0, 9)))
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert codec.encode(s) == ",".join(map(str, ids)), s
        assert codec.decode(codec.encode(s)) == theirs.decode(ids, skip_special_tokens=False), s


def test_lexicon_holds_its_words_alone():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "xbc", "xbd", "é", "zzz", "station", "nation"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert not any(lexicon.get(w) for w in (b"", b"b", b"abcd", b"x", b"xb", b"zz"))
    assert lexicon.states < sum(map(len, words))  # suffixes are shared


def test_bpe_edges(edges, empty):
    got = bpe.coded(edges, bpe.tokenizer_path()).select("text", "bpe.*").collect()
    assert [r.n_tokens for r in got if not r.text] == [0, 0]
    assert bpe.coded(empty, bpe.tokenizer_path()).count() == 0


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[: len(docs.columns)] == docs.columns
    kept = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert len(kept) == out.count() and len(kept) > 700
    bench = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    matcher = decontam.Matcher(bench)
    assert not any(matcher.find(t) for t in kept.values())
    prints = [simhash.fingerprint(t, 5) for t in kept.values()]
    assert len(set(prints)) == len(prints)
    good = {r.doc_id for r in common.table(spark, DATA, "labels").filter("quality = 1").collect()}
    base = {r.doc_id for r in quality.op4_quality_rules(spark, DATA).filter("not base_failed").collect()}
    assert len(good & base & set(kept)) > 0.8 * len(good & base)
