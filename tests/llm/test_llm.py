"""The text operators against brute force, the libraries and edge cases: nulls, empty and very long texts, ties and
repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm import chat, decontaminate, html_extract, language_id, minhash_dedup, quality_rules, registry, sentencepiece_lattice, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
BPE, WORD = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
LONG = "long " * 30_000 + "a" * 20_000
DOCS = [(1, "One two three, four five six seven eight nine ten eleven twelve."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "One two three, four five six seven eight nine ten eleven twelve."), (6, "One two three, four five six seven eight nine ten eleven twelve."), (7, "Été ñandú ß \U0001F600 日本語 <s> <|endoftext|> é"), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators use."""
    rows = [(i, t, "en", "src", 1, 0.5, "k", 2, 3) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, set_key string, label int, id int")


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (5, 0, 1), (6, 1, 0), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- toxicity


def test_toxicity(spark, docs, none, labels):
    for marks in (labels, labels.limit(0)):
        rows = toxicity.scored(docs, marks).collect()
        assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.cleaned(docs, labels).columns == docs.columns


def test_machine_learns_pairs():
    """Two terms are toxic only together: no linear weights can tell."""
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.choice(2, 2).tolist()) if k % 2 else {int(rng.integers(2))}) for k in range(400)]
    y = np.array([len(r) == 2 for r in rows])
    bias, w, v = toxicity.train(rows, y, 2)
    s = toxicity.Machine(np.arange(2), bias, w, v).scores([{0}, {1}, {0, 1}])
    assert s[2] > 0.5 > max(s[0], s[1])


def test_scores_by_brute_force():
    """Bias, weights and all pairs one by one, whatever rows are gathered together."""
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(50), -0.3, rng.normal(0, 0.5, 50).astype(np.float32), rng.normal(0, 0.3, (50, toxicity.FACTORS)).astype(np.float32))
    rows = [set(rng.choice(50, rng.integers(0, 20), replace=False).tolist()) for _ in range(40)]
    want = []
    for r in map(sorted, rows):
        x = m.bias + sum(float(m.weights[i]) for i in r) + sum(float(m.vectors[i].astype(float) @ m.vectors[j].astype(float)) for n, i in enumerate(r) for j in r[n + 1 :])
        want.append(1 / (1 + np.exp(-x)))
    assert np.allclose(m.scores(rows), want)
    toxicity.TOGETHER, before = 30, toxicity.TOGETHER
    assert np.allclose(m.scores(rows), want)
    toxicity.TOGETHER = before


def test_toxicity_held_out(spark, tmp_path):
    rng, words = random.Random(5), [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(800):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 7 == 0
        if bad:
            text.insert(rng.randrange(60), rng.choice(["fiend", "lout", "fiendish"]))
        rows.append((i, " ".join(text), 1, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")).collect()}
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == rows[i][3] for i in held) >= 0.97 * len(held)


def marked_texts(n, marks):
    """n texts of neutral words, the k-th with the words of marks(k) put in."""
    rng, words = random.Random(11), [f"q{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(40)]
        for m in marks(k)[0]:
            text.insert(rng.randrange(40), m)
        rows.append((k, " ".join(text), int(marks(k)[1])))
    return rows


def held_out_accuracy(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [k for k, _, _ in rows if got[k].held_out]
    return np.mean([got[k].predicted == rows[k][2] for k in held])


def test_toxicity_pairs_of_neutral_terms(spark):
    """Either term alone has a toxic share near that of all rows; both together are always toxic."""
    cases = [(["vex", "norl"], 1), (["vex"], 0), (["vex"], 0), (["vex"], 0), (["norl"], 0), (["norl"], 0), (["norl"], 0), (["lout"], 1)]
    assert held_out_accuracy(spark, marked_texts(1600, lambda k: cases[(k * 2654435761 >> 7) % 8])) >= 0.95


def test_toxicity_more_than_half_toxic(spark):
    """Nothing can be three times as toxic as the rest, and terms that speak for a clean text count too."""
    assert held_out_accuracy(spark, marked_texts(800, lambda k: (["fiend"], 1) if k % 5 < 3 else (["thanks"], 0))) >= 0.97


# ---- decontamination

ITEMS = [(1, "three four five six seven eight nine ten eleven twelve"), (2, "two three"), (3, None), (4, ""), (5, "LONG long"), (5, "日本語"), (None, "four five six"), (None, "seven"), (6, "long " * 12)]


def result(hits):
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.digest(hits).collect())


def test_decontamination(spark, docs, none):
    """Repeated rows, rows of one doc_id with different texts and rows without an id give a row each; so do items."""
    texts = [*DOCS, (1, "three four five six seven eight nine ten eleven twelve and two three"), (None, "two three"), (None, None), (None, "no id here")]
    bench = spark.createDataFrame([(i, t, i, "x") for i, t in ITEMS], "item_id long, text string, key long, windows string")
    rows = spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id long, text string, key string, salt__ int").drop("salt__")
    assert result(decontaminate.contamination(rows, bench)) == collections.Counter((i, *decontaminate.brute_force(t, ITEMS)) for i, t in texts)
    clean = collections.Counter((i, t) for i, t in texts if not decontaminate.brute_force(t, ITEMS)[1])
    for few in (decontaminate.FEW_TEXTS, 0):
        kept = decontaminate.cleaned(rows, bench, few=few)
        assert kept.columns == rows.columns and collections.Counter((r.doc_id, r.text) for r in kept.collect()) == clean
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.cleaned(none, bench).count() == 0
    assert decontaminate.cleaned(docs, bench.limit(0)).count() == len(DOCS)
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_winnowing_finds_every_window(spark, seed):
    """Random texts of few words, so windows, short items and repeats meet in all ways."""
    rng = random.Random(seed)
    draw = lambda words, most: " ".join(rng.choices(words, k=rng.randrange(most)))
    words = ["a", "b", "c", "d", "E,"][: 2 + seed]
    items = [(k, draw(words, 30)) for k in range(6)]
    texts = [(k, draw(words, 80)) for k in range(150)] + [(900 + k, draw(words, 9) + " z " + t + " z " + draw(words, 9)) for k, t in items]
    rows, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.contamination(rows, bench)) == collections.Counter((i, *decontaminate.brute_force(t, items)) for i, t in texts)


def test_a_large_benchmark_is_one_pass(spark):
    """Many items, each planted once, against all documents: one scan of them, and nothing of the benchmark's size is broadcast."""
    rng, words = random.Random(7), [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=40))) for k in range(3000)]
    texts = [(k, " ".join([*rng.choices(words, k=30), *items[k * 30][1].split()[5:17], *rng.choices(words, k=30)])) for k in range(100)] + [(1000 + k, " ".join(rng.choices(words, k=90))) for k in range(100)]
    rows, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(rows, bench).collect()}
    assert len(got) == 200
    for k in range(100):
        assert got[k].items == [k * 30] and got[k].n_hit == 12 and got[1000 + k].n_hit == 0


# ---- SentencePiece


def test_long_units_fold_like_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
    pieces = sentencepiece_lattice.Pieces.load(BPE)
    pairs = pieces.pairs()
    for t in [*(t for _, t in DOCS), "a" * 3000, " " * 99, "x  y   z\n\n q \n", "日本語テキスト"]:
        units = [u for w in sentencepiece_lattice.words_of(t) for u in sentencepiece_lattice.units_of(w, pairs)]
        assert [i for u in units for i in pieces.fold(u)] == sp.encode(t or "")


def test_lattice_is_the_library(spark):
    """Every text of a whole table, and random strings of awkward characters, long units and several chunks a task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in whole.collect()}
    for r in sentencepiece_lattice.round_trip(whole, BPE).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(array("i", ids).tobytes()), True)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "\U0001F600", "the", "there", "ing", "er", "h", "e", "re", "▁", "\0", ",", "'s", "1", "12"]
    odd = ["".join(rng.choices(parts, k=rng.randrange(1, 90))) for _ in range(3000)] + ["a" * 500, "ab" * 300, "the" * 21]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    pieces = sentencepiece_lattice.Pieces.load(BPE)
    assert all(list(r.ids) == sp.encode(odd[r.doc_id]) for r in sentencepiece_lattice.encode(df, pieces, chunk=5000).collect())


def test_a_merge_that_lets_a_better_one_in(spark):
    """ab is merged late, and only then can abc, which scores better, be."""
    toy = sentencepiece_lattice.Pieces({"a": 1, "b": 2, "c": 3, "ab": 4, "abc": 5, "cd": 6, "d": 7}, {"a": -9.0, "b": -9.0, "c": -9.0, "d": -9.0, "ab": -5.0, "abc": -1.0, "cd": -6.0}, [""] * 8, None, 3)
    words = spark.createDataFrame([("abcd",), ("abc",), ("cdab",)], "word string")
    got = {r.word: list(r.ids) for r in sentencepiece_lattice.encode_words(words, toy.frame(spark), 3, None).collect()}
    assert got == {w: toy.fold(w) for w in got} and got["abcd"] == [5, 7]


def test_sentencepiece_relations(spark, docs, none):
    import sentencepiece

    pieces = sentencepiece_lattice.Pieces.load(BPE)
    toy = spark.createDataFrame([("a", 1, -2.0), ("b", 2, -2.0), ("ab", 3, -3.0), ("abc", 4, -9.0), ("c", 5, -1.0), ("bc", 6, -2.5)], "piece string, id int, score double")
    words = spark.createDataFrame([("abc",), ("aab",), ("xab",)], "word string")
    best = {r.word: r.ids for r in sentencepiece_lattice.encode_words(words, toy, 3, None, "viterbi").collect()}
    assert best == {"abc": [3, 5], "aab": [1, 3], "xab": [0, 3]}
    strange = spark.createDataFrame([("\U0001F600b",), ("日x",), ("▁▁▁x",), ("\n",)], "word string")
    for r in sentencepiece_lattice.encode_words(strange, pieces.frame(spark), pieces.longest, pieces.first_byte).collect():
        assert r.ids == pieces.fold(r.word)
    for chunk in (sentencepiece_lattice.CHUNK, 10):
        rows = sentencepiece_lattice.round_trip(docs, BPE, chunk).collect()
        assert len(rows) == len(DOCS) and all(r.round_trip for r in rows)
        sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
        assert all(r.n_tokens == len(sp.encode(next(t for i, t in DOCS if i == r.doc_id) or "")) for r in rows)
    assert not sentencepiece_lattice.round_trip(spark.createDataFrame([(1, "x▁y")], "doc_id long, text string"), BPE).first().round_trip
    assert sentencepiece_lattice.round_trip(none, BPE).count() == 0
    ids = sentencepiece_lattice.encode(docs, pieces).select("doc_id", "ids")
    assert {(r.doc_id, tuple(r.ids)) for r in ids.collect()} == {(i, tuple(sp.encode(t or ""))) for i, t in DOCS}
    assert {(r.doc_id, r.text) for r in sentencepiece_lattice.decode(ids, pieces).collect()} == {(i, t or "") for i, t in DOCS}


# ---- language ID


def test_language_id(spark, docs, none):
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><article><p>der die und das ist nicht</p></article>'), (2, None, None), (3, "", ""), (1, "http://a.example.de/x", '<html lang="de"><article><p>der die und das ist nicht</p></article>'), (4, "http://b.co.uk", "<p>" + LONG)], "page_id long, url string, html string")
    rows = language_id.identify(pages, documents(spark)).collect()
    assert len(rows) == 5 + documents(spark).count()
    assert {r.lang for r in rows if r.page_id == 1} == {"de"} and all(0 < r.confidence <= 1 for r in rows)
    want = {r.doc_id: r.lang for r in documents(spark).collect()}
    assert np.mean([r.lang == want[r.doc_id] for r in rows if r.doc_id is not None]) > 0.98
    assert language_id.identify(pages, none).count() == 5
    assert language_id.identify(pages.limit(0), docs).count() == len(DOCS)
    assert language_id.identify(pages.limit(0), none).count() == 0
    assert language_id.address("https://u@Blog.example.co.uk:80/p?q") == ("blog.example.co.uk", "example.co.uk", "uk")


def test_language_held_out(spark):
    """Fitted on half of the documents, judged on the other half, and on pages by the language that their address names."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fitted = language_id.fit(docs.where("doc_id % 2 = 0"))
    best = lambda text: fitted.languages[int(np.argmax(fitted.text(text)))]
    held = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    assert np.mean([best(r.text) == r.lang for r in held if fitted.text(r.text)]) > 0.95
    bare = pages.withColumn("html", F.regexp_replace("html", '<html lang="..">', "<html>")).withColumn("url", F.regexp_replace("url", "/(en|de|fr|es)/", "/"))
    want = {r.page_id: re.search("/(en|de|fr|es)/", r.url)[1] for r in pages.collect() if re.search("/(en|de|fr|es)/", r.url)}
    got = {r.page_id: r.lang for r in language_id.identify(bare, docs).collect() if r.page_id is not None}
    assert len(want) > 100 and np.mean([got[i] == x for i, x in want.items()]) > 0.9


def test_language_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("page", 1, [1.0, 1.0], None, None, None, None), ("page", 2, None, None, None, None, None)], "kind string, id long, likelihood array<double>, declared string, host string, domain string, suffix string")
    both = df.unionByName(df.where("id = 1").withColumn("likelihood", F.array(F.lit(0.0), F.lit(5.0))).withColumn("id", F.lit(3)))
    assert {r.id: r.lang for r in language_id.fuse(both, ["de", "en"]).collect()}[1] == "de"


def test_every_labelled_language_is_known(spark):
    """More languages than 64, and rare ones beside a common one."""
    rng, rows = random.Random(3), []
    for k in range(70):
        letters = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(40)), f"l{k:02}", None) for i in range(60 if k == 0 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = sorted({r[2] for r in rows})
    assert language_id.fit(df, sample=5).languages == names
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = {r.doc_id: r.lang for r in language_id.identify(pages, df).collect()}
    assert np.mean([got[i] == lang for i, _, lang, _ in rows]) > 0.95 and len(set(got.values())) > 64


def test_host_and_declaration_decide_where_text_is_silent(spark):
    rows = [("page", k, [2.0, 1.0], "en" if k % 2 else "fr", "h1", "d1", "com") for k in range(20)] + [("page", 100 + k, [1.0, 2.0], "fr", "h2", "d2", "fr") for k in range(20)] + [("page", 200, None, None, "h2", "d2", "fr"), ("page", 201, None, "fr", None, None, None)]
    df = spark.createDataFrame(rows, "kind string, id long, likelihood array<double>, declared string, host string, domain string, suffix string")
    got = {r.id: r.lang for r in language_id.fuse(df, ["en", "fr"]).collect()}
    assert got[200] == "fr" and got[201] == "fr" and got[1] == "en" and len(got) == len(rows)


# ---- quality rules


def brute_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, seen, lines = collections.Counter(runs), set(), 0
    hit = {k for i, r in enumerate(runs) if count[r] > 1 for k in (i, i + 1, i + 2)}
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality(spark, docs, none, labels):
    more = spark.createDataFrame([(20, "a b c a b c a b c d"), (21, "x\nx\n\nx\ny # $$\x0b|"), (22, "a a a a a"), (23, " ".join(map(str, range(60))))], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    texts = dict(DOCS) | {r.doc_id: r.text for r in more.collect()}
    for marks in (labels, labels.limit(0)):
        rows = quality_rules.digest(quality_rules.judged(both, marks)).collect()
        assert len(rows) == len(DOCS) + 4
        for r in rows:
            assert tuple(r)[1:7] == brute_quality(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.passing(docs, labels).columns == docs.columns
    plan = quality_rules.judged(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verdict_is_the_list(spark):
    """The CASE expression against the rules applied one by one, and the list's worth on labels that it has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    rules = quality_rules.learned(docs, labels.where(seen))
    assert rules
    few = docs.join(labels.where(~seen).select("doc_id", "quality"), "doc_id")
    stats = quality_rules.statistics(few).withColumn("failed", quality_rules.base_failed()).withColumn("rule", quality_rules.verdict(rules))
    right = total = 0
    for r in stats.select("row.quality", "failed", "rule", *quality_rules.FEATURES).collect():
        row = r.asDict()
        assert r.rule == next((k for k, rule in enumerate(rules, 1) if all(c.holds(row) for c in rule)), 0)
        if not r.failed:
            total += 1
            right += (r.rule == 0) == (r.quality == 1)
    assert total > 500 and right >= 0.97 * total


def test_decision_list_learns_a_conjunction():
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        r = dict.fromkeys(quality_rules.FEATURES, 0.0) | {"mean_word": rng.random() * 10, "mark_share": rng.random()}
        rows.append(r | {"bad": int(r["mean_word"] > 6 and r["mark_share"] < 0.5)})
    cuts = {f: sorted({r[f] for r in rows})[::10] for f in ("mean_word", "mark_share")}
    rule = quality_rules.prune(quality_rules.grow(rows[:400], cuts), rows[400:])
    assert {c.feature for c in rule} == {"mean_word", "mark_share"}
    assert quality_rules.precision(rule, rows)[0] > 0.9


# ---- token counts


def test_token_counts(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
    for chunk, overlap in ((20_000, 256), (300, 16)):
        rows = token_counts.count_tokens(docs, BPE, chunk, overlap).collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            t = next(t for i, t in DOCS if i == r.doc_id) or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t))) and r.over_limit == (r.n_tokens > 4096)
    assert token_counts.count_tokens(none, BPE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "é", "日", "\U0001F600", "the", "▁"]), max_size=300).map("".join))
def test_splices_do_not_change_counts(text):
    c = test_splices_do_not_change_counts.__dict__.setdefault("counter", token_counts.Counter(BPE, 40, 4))
    assert c.count(text) == len(c.sp.encode(text))


# ---- token files


def test_token_files(spark, docs, none, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORD)
    shards = token_files.write_tokens(docs, WORD, f"file://{tmp_path}/t", length=16, shards=3).cache()
    got = token_files.digest(token_files.read_tokens(shards)).collect()
    at, want = 0, set()
    for i, t in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        want.add((i, at, len(ids), token_files.crc32_of(ids)))
        at += len(ids)
    assert {tuple(r) for r in got} == want and len(got) == len(DOCS)
    total = real = 0
    for path in (tmp_path / "t").glob("*.arrow"):
        with pa.memory_map(str(path)) as f:
            table = pa.ipc.open_file(f).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        total += table.num_rows * 16
        real += sum(sum(m) for m in table.column("mask").to_pylist())
    assert real == at <= total
    # an in-memory table, whose size the optimiser does not know: shards follow from the bytes
    few = token_files.write_tokens(docs, WORD, f"file://{tmp_path}/few").collect()
    assert len(few) == 1 and few[0].n_tokens == at
    empty = token_files.write_tokens(none, WORD, f"file://{tmp_path}/n").cache()
    assert empty.count() == 0 and token_files.read_tokens(empty).count() == 0


@pytest.mark.parametrize("kind", ["byte", "large"])
def test_token_files_of_other_tokenizers(spark, docs, tmp_path, kind):
    """One that keeps white space, which words cannot be taken from, and one whose ids need four bytes."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    file = P.path("byte_bpe_50k.json")
    if kind == "large":
        large = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"long": 70_000, "?": 70_001}, unk_token="?"))
        large.pre_tokenizer = pre_tokenizers.Whitespace()
        file = str(tmp_path / "large.json")
        large.save(file)
    tk = Tokenizer.from_file(file)
    shards = token_files.write_tokens(docs, file, f"file://{tmp_path}/t", length=32, shards=2).cache()
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digest(token_files.read_tokens(shards)).collect())
    ids = [(i, tk.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in DOCS]
    assert got == collections.Counter((i, len(x), token_files.crc32_of(x)) for i, x in ids)


# ---- chat


def test_chat(spark):
    rows = [(1, 1, "assistant", "a\\[x]</s>\n<s>[user] hi [/user]</s>"), (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "second[+]"), (2, 0, None, None), (2, None, "user", ""), (3, 0, "odd]role", "t"), (3, 0, "odd]role", "t"), (None, 0, "user", "u"), (4, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted int, turns string")
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    back = {r.conv_id: r for r in chat.parse(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in turns]
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said))
    assert {r.conv_id: r.n_blocks for r in formatted.collect()}[1] == 2
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_a_long_conversation(spark):
    """Thousands of turns: every assistant text is under the mask, once and in order."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn [{t}]") for t in range(6000)]
    got = chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    said = "".join(x for _, _, r, x in rows if r == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (6000, len(said), hashlib.sha256(said.encode()).hexdigest())


# ---- near-duplicates


def brute_components(texts):
    sets, best = {}, {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, docs, none):
    rng, words = random.Random(4), [f"w{i}" for i in range(500)]
    texts, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(120):
        if i % 3 == 0:  # chains: every copy changes the one before
            base = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                base[rng.randrange(200)] = rng.choice(words)
            texts.append((i + 10, " ".join(base)))
        elif i % 3 == 1:  # a common passage that does not make a link
            texts.append((i + 10, " ".join([*base[:60], *(rng.choice(words) for _ in range(60))])))
        else:
            texts.append((i + 10, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))))
    df = spark.createDataFrame(texts, "doc_id long, text string").unionByName(docs, allowMissingColumns=True)
    got = minhash_dedup.near_duplicates(df).collect()
    want = brute_components([*texts, *((i, t) for i, t in DOCS if i is not None)])
    assert len(got) == len(texts) + len(DOCS)
    for r in got:
        if r.doc_id is None:
            assert not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = minhash_dedup.deduplicated(df)
    assert kept.columns == df.columns
    # rows without words all stay, repeated rows count once, and so does the row without an id, which is like no other
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.doc_id for r in got if r.kept})
    assert kept.where("doc_id is null").count() == 1
    assert minhash_dedup.near_duplicates(none).count() == 0 and minhash_dedup.deduplicated(none).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """Each text has its own links, whichever rows share its id."""
    rng, words = random.Random(9), [f"w{i}" for i in range(500)]
    one, two = ([rng.choice(words) for _ in range(80)] for _ in range(2))
    near = lambda w: " ".join([*w[:40], "new", *w[41:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(two)), (3, near(one)), (None, near(one) + " more"), (None, " ".join(two))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, 1, False): 2}
    assert sorted(r.text for r in minhash_dedup.deduplicated(df).collect()) == sorted(rows[k][1] for k in (0, 1))


def test_a_hub_of_many_near_copies(spark):
    """One large group of near copies beside many that share a passage with it: blocks and salts change no link."""
    rng, words = random.Random(2), [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(1, 260):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = rng.choice(words)
        texts.append((i, " ".join(w if i % 3 else [*w[:70], *(rng.choice(words) for _ in range(60))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_components(texts)


def test_sketches():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**63, 3000).astype(np.uint64)
    two = np.concatenate([one[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)])
    a, b, whole = minhash_dedup.registers([one[:1000], one[1000:], one])
    assert (np.maximum(a, b) == whole).all()  # sketches of parts merge
    x, y = minhash_dedup.registers([one, two])
    assert abs((x == y).mean() - 2400 / 3600) < 0.12
    n = np.array([3000.0])
    assert minhash_dedup.likely(x[None], y[None], n, n, 0.75)[0]
    z = minhash_dedup.registers([rng.integers(0, 2**63, 3000).astype(np.uint64)])
    assert not minhash_dedup.likely(x[None], z, n, n, 0.75)[0]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 499)]
    got = {r.id: r.comp for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {499: 499, 500: 499, 501: 499}


# ---- HTML


def test_html():
    long = "The story of the town is told and it was long in the making for all. "
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{{}}</style></head><body>
    <header>Site <b>name</b></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="sidebar-left"><p>{long * 3}</p></div>
    <article><h1>A &amp; B</h1><p>Short&nbsp;one.<br>Next</p><p>{long * 2}<p>tail <a href=x>link</a> text that goes on</article>
    <section id="comments"><p>{long * 2}</p></section><div class="cookie-notice">We use cookies</div><form>Name</form><footer>&copy; x</footer>"""
    assert html_extract.main_text(page) == f"A & B\nShort one. Next\n{(long * 2).strip()}\ntail link text that goes on"
    plain = f"<body><div><a href=1>one</a> <a href=2>two</a></div><p>{long * 2}</p><p>It is so.</p><p>{long * 2}</p><div><a href=3>more</a></div></body>"
    assert html_extract.main_text(plain) == "\n".join([(long * 2).strip(), "It is so.", (long * 2).strip()])
    for broken in (None, "", "<", "<a " * 30_000, "<p title='" * 20_000, "<div>" * 30_000, "</p>" * 9, "<!--", "&#xZZ; &bogus; x<"):
        assert isinstance(html_extract.main_text(broken), str)


def test_html_after_a_marked_paragraph_item_and_cell():
    a, b, c = ("%s is the story of the town that was told for all and it is long enough by itself." % x for x in "ABC")
    for open_, shut in (("<p%s>", "</p>"), ("<p%s>", ""), ("<ul><li%s>", "</li></ul>"), ("<table><tr><td%s>", "</td></tr></table>"), ("<dl><dd%s>", "</dd></dl>")):
        for mark in (' class="ad"', " hidden", ' style="display: none"', ' role="banner"'):
            block = lambda m, t: (open_ % m) + t + shut  # noqa: B023, E731
            page = f"<article>{block('', a)}{block(mark, 'x')}{block('', b)}{block('', c)}</article>"
            assert html_extract.main_text(page) == f"{a}\n{b}\n{c}"
    for tag, parent in (("li", "ul"), ("td", "tr"), ("dd", "dl"), ("tr", "table")):
        for end in (f"</{tag}>", ""):
            page = f"<article><{parent}><{tag}>{a}{end}<{tag} class=ad>x{end}<{tag}>{b}{end}</{parent}>{c}</article>"
            assert html_extract.main_text(page) == f"{a}\n{b}\n{c}"
    nested = f"<article><ul><li class=ad>x<ul><li>{a}</li></ul>{b}</li><li>{c}</li></ul></article>"
    assert html_extract.main_text(nested) == c


def test_html_of_other_languages():
    for text in (
        "Летом город был почти пуст, и только на площади у старого театра вечером собирались люди, чтобы послушать музыку.",
        "Latem miasto było prawie puste, tylko na placu przed starym teatrem wieczorami zbierali się ludzie, żeby posłuchać muzyki.",
        "夏天的城市几乎空无一人，只有老剧院前面的广场上，每到傍晚人们才会聚在一起听音乐，谈论这一年里发生的事情，直到深夜才慢慢散去回家，第二天又重新开始。" * 2,
    ):
        page = f"<body><ul><li><a href=1>{text[:20]}</a></li></ul><div>{text}</div><p>{text[:9]}</p><p>{text}</p><div><a href=2>{text}</a></div><div class=footer>{text}</div></body>"
        assert html_extract.main_text(page) == f"{text}\n{text[:9].strip()}\n{text}"
    known = "The story of the town is told and it was long in the making for all of them. " * 2
    assert html_extract.main_text(f"<div>{known}</div><section class=x><div><aside></aside></div></section><form></form>") == known.strip()


def test_html_short_blocks_of_an_article_inherit():
    long = "The story of the town is told and it was long in the making for all of them."
    page = f"<article><p>{long}</p><p>It is so.</p><p>{long}</p><ul><li><a href=1>one</a></li><li>See too</li><li><a href=2>two</a></li></ul></article>"
    assert html_extract.main_text(page) == f"{long}\nIt is so.\n{long}"
    assert html_extract.main_text("<article><p>Hi</p><p>there</p></article>") == "Hi\nthere"


def test_html_offsets_and_links():
    long = "The story of the town is told and it was long in the making for all of them."
    assert html_extract.main_text(f"<article><p>{'İ' * 20} {long}</p><SCRIPT>var a = 1;</Script><p>Hello world, {long}</p></article>") == f"{'İ' * 20} {long}\nHello world, {long}"
    # a link around a block is one, a link without an end tag ends with its block
    assert html_extract.main_text(f"<article><p>{long}</p><a href=1><div>{long[:-1]}</div></a><p>{long}</p></article>") == f"{long}\n{long}"
    assert html_extract.main_text(f"<article><p><a href=1>{long[:40]}<p>{long}</p><p>{long}</p></article>").endswith(f"{long}\n{long}")
    # a linked sentence of an article stays between paragraphs, a list of links does not
    assert html_extract.main_text(f"<article><p>{long}</p><p><a href=1>{long}</a></p><p>{long}</p></article>") == "\n".join([long] * 3)
    assert html_extract.main_text(f"<article><p>{long}</p><ul><li><a href=1>The town</a></li><li><a href=2>All of them</a></li></ul><p>{long}</p></article>") == f"{long}\n{long}"


def test_html_rules_decide_inside_articles():
    """Density and neighbours, not the article's tag, take a block without stop words beside links out, and leave one beside prose."""
    long = "The story of the town is told and it was long in the making for all of them."
    bare = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon"
    page = f"<article><p>{long}</p><p>{bare}</p><p>{long}</p><div><a href=1>one two three</a></div><p>{bare}</p><div><a href=2>four five six</a></div></article>"
    told = html_extract.explained(page)
    assert [(k, r) for _, k, r in told] == [(True, "stop words"), (True, "neighbour"), (True, "stop words"), (False, "links"), (False, "neighbour"), (False, "links")]


def test_html_of_real_pages(spark):
    """All pages of a table against a plain reading of how they are made: an article's heading and paragraphs."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rules = collections.Counter()
    for r in rows:
        told = html_extract.explained(r.html)
        rules.update(rule for _, _, rule in told)
        article = re.search("<article>(.*?)</article>", r.html, re.S)
        if article and not re.search("<(?!/?(?:p|b|h1|br)\\b)", article[1]):
            parts = [re.sub("<[^>]*>", " ", x) for x in re.split("</?(?:p|h1)>", article[1])]
            import html

            want = [" ".join(html.unescape(x).split()) for x in parts]
            assert "\n".join(t for t, k, _ in told if k) == "\n".join(x for x in want if x)
    assert rules["stop words"] > 100 and rules["neighbour"] > 100 and rules["links"] > 100 and rules["marked"] > 100


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi there</p></article>", "x"), (2, None, None, "y"), (1, "u", "<article><p>Hi there</p></article>", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == [(1, "Hi there", 8), (1, "Hi there", 8), (2, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


# ---- registry and pipeline


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs, seen = documents(spark), None
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from emberlog.llm import common

    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            seen = {r.doc_id for r in toxicity.scored(docs, labels).collect() if not r.predicted}
        elif name == "quality_rules":
            seen = {r.doc_id for r in quality_rules.judged(docs, labels).collect() if r.kept}
        elif name == "near_dedup":
            seen = {i for i, (_, c) in brute_components(list(before.items())).items() if i == c}
        elif name == "decontaminate":
            seen = {i for i, t in before.items() if not decontaminate.brute_force(t, benchmark)[1]}
        columns = docs.columns
        docs = common.cut(stage(spark, docs, SF), name)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == seen
        if name != "sentencepiece":
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0
    before = set(common.WRITTEN)
    done = cp.run(spark, SF)
    assert {r.doc_id for r in done.collect()} == seen and len(common.WRITTEN - before) == 1
    common.clean(spark, before)
    assert common.WRITTEN == before


def test_stages_begin_with_small_heaps(spark, none):
    """Executors outlive stages: what one left in the heap (2.1 GB of an executor) was added to what the next one needs."""
    import corpus_pipeline as cp

    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName())]
    full = lambda: sum(b.getCollectionCount() for b in beans)
    for name, stage in cp.STAGES:
        before = full()
        stage(spark, none, SF)
        assert full() > before, name


def test_heaps_are_small_before_a_stage_and_its_last_job(monkeypatch):
    import corpus_pipeline as cp

    seen = []
    monkeypatch.setattr(cp.C, "release_heaps", lambda spark: seen.append("released"))
    assert cp.lean(lambda spark, docs, sf_dir: seen.append("stage") or docs)(None, "rows", SF) == "rows"
    assert seen == ["released", "stage", "released"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, one id with two texts, a very long text, extra columns, and empty tables."""
    import corpus_pipeline as cp

    rng, words = random.Random(1), [f"word{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    one, two, three, leak = text(80), text(90), text(20_000), text(60)
    rows = [(1, one), (1, one), (1, two), (2, one + " more"), (None, two + " again"), (None, text(70)), (3, None), (4, ""), (5, "short"), (6, three), (7, leak)]
    docs = spark.createDataFrame([(i, t, None, "s", None, "k", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, label int, score double")
    docs.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, 1, 0), (None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, " ".join(leak.split()[5:40])), (None, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/{d}/benchmark.parquet")
    kept = docs
    for name, stage in cp.STAGES[:4]:
        kept = stage(spark, kept, f"file://{tmp_path}/a")
        assert kept.columns == docs.columns, name
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, rows[5][1]), (1, one), (1, two), (6, three)])
    done = cp.run(spark, f"file://{tmp_path}/a").collect()
    assert sorted(r.doc_id or 0 for r in done) == [0, 1, 1, 6] and all(r.round_trip for r in done)
    assert cp.run(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    found = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(found.fetchall())
