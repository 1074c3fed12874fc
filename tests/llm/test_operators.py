"""Operators of the llm subpackage against brute force, and on nulls, empty and very long texts, ties, empty tables and clashing columns."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.llm import decontaminate, langid, line_dedup, pieces, pii, quality, simhash, suffix_tree, toxicity, version_sketch
from talweg.llm.common import remainder, spread_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of no id", "en", None, 5), (3, "same text twice", "en", "s", 1), (3, "same text twice", "en", "s", 1),
    (4, "x" * 200_000, "en", "s", 1), (5, "\n\n \t\n", "en", "s", 1), (6, "日本語 é\u0000 ▁ 😀", "xx", "s", 1), (7, "word " * 30_000, "en", "s", 1),
]
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# Line dedup


def brute_lines(texts, n):
    lines = {d: [(i, s) for i, x in enumerate(t.split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))] for d, t in texts.items()}
    at = defaultdict(list)
    for d in sorted(lines):
        for k, (_, x) in enumerate(lines[d]):
            at[x].append((d, k))
    gone = defaultdict(set)
    for d, own in lines.items():
        for k, (i, x) in enumerate(own):
            for e, m in at[x]:
                if (e, m) >= (d, k):
                    continue
                other, a, b = lines[e], 0, 0
                while k > a and m > a and own[k - a - 1][1] == other[m - a - 1][1]:
                    a += 1
                while k + b + 1 < len(own) and m + b + 1 < len(other) and own[k + b + 1][1] == other[m + b + 1][1]:
                    b += 1
                if sum(len(y.split()) for _, y in own[k - a : k + b + 1]) >= n:
                    gone[d].add(i)
                    break
    return gone


def check_lines(spark, texts, n):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df, n).collect()}
    gone = brute_lines(texts, n)
    for d, t in texts.items():
        assert found[d] == ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])), d


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pool = [" ".join("w%d" % rng.integers(4) for _ in range(k)) for k in (1, 1, 2, 3, 5, 8)] + ["", "  "]
    texts = {i: "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 14))) for i in range(60)}
    for n in (3, 6, 10):
        check_lines(spark, texts, n)


def test_equal_runs_share_a_fingerprint_and_few_lines_are_one(spark):
    rng = np.random.default_rng(3)
    run = [f"r{i} " * int(rng.integers(1, 9)) for i in range(60)]
    texts = {d: "\n".join([f"own {d} {i}" for i in range(40)] + run + [f"end {d} {i}" for i in range(40)]) for d in range(4)}
    found = line_dedup.windows(line_dedup.line_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).cache()
    rows = line_dedup.fingerprints(found).collect()
    assert len(rows) < found.count() / 3 and sum(len(r.found) for r in rows) == found.count()
    inside = defaultdict(set)
    for r in rows:
        if 40 <= r.at < 100:
            inside[r.id].add((r.at, r.mark))
    assert len(inside) == 4 and len(set.intersection(*inside.values())) > 3


def test_a_run_that_a_third_of_documents_hold_is_removed(spark):
    run = "\n".join(f"licence line {i} of many words in it" for i in range(12))
    texts = {d: f"own text {d} before\n{run}\nown text {d} after" for d in range(300)} | {d: f"document {d} alone" for d in range(300, 900)}
    check_lines(spark, texts, 50)


def test_line_dedup_catches_long_passages_and_leaves_short_ones(spark):
    long = " ".join(f"p{i}" for i in range(55))
    a = spark.createDataFrame([(1, f"one\n{long}\ntwo"), (2, f"three\n  {long}\nfour"), (3, "one\ntwo")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(a).collect()} == {1: f"one\n{long}\ntwo", 2: "three\nfour", 3: "one\ntwo"}


def test_line_dedup_on_odd_rows(odd, none):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.text or "") for r in rows) == sorted((x[1] or "") for x in ODD)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_keeps_other_columns(spark):
    long = " ".join(f"p{i}" for i in range(55))
    df = spark.createDataFrame([(1, long, 7, "a"), (2, long, 8, "b")], "doc_id long, text string, id long, gone string")
    assert sorted((r.doc_id, r.text, r.id, r.gone) for r in line_dedup.dedup_lines(df).collect()) == [(1, long, 7, "a"), (2, "", 8, "b")]


def test_line_dedup_splits_a_long_text_once(spark):
    run = [f"shared line {i} of the run" for i in range(12)]
    texts = {d: "\n".join([f"own {d} {i}" for i in range(3000)] + run + ["", f"end {d}"]) for d in range(2)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = line_dedup.dedup_lines(df)
    # A lambda's body is worked out for every element, so a split in one takes the square of the number of lines.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == {0: (texts[0], 0), 1: (texts[1].replace("\n".join(run) + "\n", ""), 12)}


def test_lines_of_repeated_rows_are_kept_once_without_a_hash_map(spark):
    rows = [(1, "a b\nc\na b"), (1, "a b\nc\na b"), (1, "a b"), (None, "a b"), (None, "a b"), (2, None)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Sort [") == 1
    assert sorted((str(r.id), r.pos, r.words, r.s, r.c) for r in lines.collect()) == [("1", 0, 2, 0, 2), ("1", 0, 2, 0, 2), ("1", 1, 1, 2, 3), ("1", 2, 2, 3, 5), ("None", 0, 2, 0, 2)]


# Language


def test_language_by_family(docs):
    sample = langid.training_sample(docs, remainder(F.col("doc_id"), 5) != 0)
    model = langid.fit(sample)
    held = docs.where(remainder(F.col("doc_id"), 5) == 0).collect()
    pred, score = model.predict([r.text for r in held])
    assert np.mean([p == r.lang for p, r in zip(pred, held, strict=True)]) > 0.9
    assert ((score >= 0) & (score <= 1)).all()
    assert langid.family("fr") == langid.family("es") != langid.family("de")


def test_a_rare_language_keeps_its_sample(spark):
    rows = [(10_000 * k + i, f"text {i}", f"l{k}") for k in range(14) for i in range(2000)] + [(900_000 + i, f"rare {i}", "rare") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = Counter(g for _, g in langid.training_sample(df, F.lit(True), 200))
    assert taken["rare"] == 50 and all(150 < taken[f"l{k}"] <= 200 for k in range(14))


def test_language_of_odd_rows(odd, none, docs):
    model = langid.fit([(r.text, r.lang) for r in docs.limit(100).collect()])
    rows = langid.identify(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert langid.identify(none, model).count() == 0
    assert langid.training_sample(none, F.lit(True)) == []
    assert langid.fit([]) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    one = langid.fit([("hello there", "en")])
    assert one.predict(["abc", "1"])[0] == ["en", "und"]


def test_a_text_scores_alike_in_any_block(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    model = langid.fit([(t, "a" if i % 2 else "b") for i, t in enumerate(texts)])
    whole = model.predict(texts)[1]
    assert np.allclose(whole, [model.predict([t])[1][0] for t in texts])


# Toxicity and quality


def test_toxic_documents_are_found(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.training_sample(docs, labels, "toxic", F.lit(True), 6000)
    assert len(sample) == labels.join(docs, "doc_id").count()
    model = toxicity.fit(sample)
    score = model.scores([t for t, _ in sample])
    assert np.mean((score >= 0.5) == [bool(y) for _, y in sample]) > 0.95


def test_quality_by_compression(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(toxicity.training_sample(docs, labels, "quality", F.lit(True), 6000))
    score = model.scores(["$$$ ".join(string.ascii_lowercase), ""])
    assert ((score >= 0) & (score <= 1)).all()


def brute_gram(text, size, bits):
    """The hashes of the n-grams of a text, one by one."""
    word = lambda x: x & 0xFFFFFFFF
    for p in range(size - 1, len(text)):
        h = 0
        for ch in text[p - size + 1 : p + 1]:
            h = word(word(h * 0x01000193) + ord(ch))
        h ^= h >> 15
        h = word(word(h + size) * 0x9E3779B1)
        h ^= h >> 13
        yield word(h * 0x85EBCA6B) >> 32 - bits


def test_toxicity_scores_equal_brute_force(docs):
    texts = [r.text for r in docs.limit(60).collect()]
    model = toxicity.fit([(t, i % 3 == 0) for i, t in enumerate(texts)])
    for t, score in zip([*texts[:25], "", "ab"], model.scores([*texts[:25], "", "ab"]), strict=True):
        met = {model.table[g] for n in toxicity.SIZES for g in brute_gram(t.lower(), n, toxicity.BITS)} - {-1}
        assert math.isclose(score, 1 / (1 + math.exp(-max(-35, min(35, model.bias + sum(model.weights[f] for f in met))))), rel_tol=1e-6)


def test_toxicity_ratios_equal_brute_force(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    label = [i % 4 == 0 for i in range(40)]
    model = toxicity.fit(list(zip(texts, label, strict=True)))
    count = {True: Counter(), False: Counter()}
    for t, y in zip(texts, label, strict=True):
        count[y].update({g for n in toxicity.SIZES for g in brute_gram(t.lower(), n, toxicity.BITS)})
    share = {y: lambda g, c=c, n=sum(c.values()) + (1 << toxicity.BITS): math.log((c[g] + 1) / n) for y, c in count.items()}
    sure = lambda g: abs(share[True](g) - share[False](g)) / math.sqrt(1 / (count[True][g] + 1) + 1 / (count[False][g] + 1))
    kept = {g for g in range(1 << toxicity.BITS) if model.table[g] >= 0}
    met = {*count[True], *count[False]}
    least = min(sure(g) for g in kept & met)
    assert sum(sure(g) > least + 1e-9 for g in met) <= toxicity.FEATURES


def test_quality_scores_equal_brute_force(spark, sf_dir, docs):
    sample = toxicity.training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", F.lit(True), 200)
    model = quality.fit(sample)
    texts = [r.text for r in docs.limit(30).collect()]
    size = lambda t, d: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in quality.text_blocks(t))
    for t, score in zip(texts, model.scores(texts), strict=True):
        if not t:
            continue
        good, bad, n = size(t, model.good), size(t, model.bad), len(t.encode())
        d, share, short = 10 * (bad - good) / (good + bad), min(good, bad) / n, 1 / (1 + len(t) / 100)
        z = float(np.dot(model.curve, [1, d, share, d * share, share**2, short, d * short, share * short]))
        # Tables made beforehand may differ by a few bytes from those made for each call.
        assert math.isclose(score, 1 / (1 + math.exp(-z)), abs_tol=0.05)


def test_quality_of_odd_texts(spark, docs):
    texts = [r.text for r in docs.limit(40).collect()]
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts)])
    rows = toxicity.score(spark.createDataFrame([(None,), ("",), ("x" * 200_000,), (texts[0],), (texts[0],)], "text string"), model).collect()
    assert rows[0].score == rows[1].score == model.prior and rows[3].score == rows[4].score and all(0 <= r.score <= 1 for r in rows)


def test_languages_equal_brute_force(docs):
    rows = docs.where("lang is not null").limit(150).collect()
    model = langid.fit([(r.text, r.lang) for r in rows])
    texts = [r.text for r in rows[:25]] + ["1 2 3", ""]
    pred, score = model.predict(texts)
    assert pred[-2:] == ["und", "und"] and (score[-2:] == 0).all()
    names = [n for c in model.languages for n in c.names]
    assert set(pred) <= {*names, "und"}
    # A text is of the family, and then the language, that wins most of its contests one against one.
    symbols = lambda t: " " + re.sub(r"[^\w]+|[\d_]+", " ", t.lower())
    for t, p in zip(texts[:25], pred, strict=False):
        if not re.fullmatch(r"[a-zA-Z0-9 .,;:!?'\n\-]*", t):
            continue
        clean = re.sub(r" +", " ", symbols(t))
        grams = [g for n in langid.SIZES for g in brute_gram(clean, n, langid.BITS)]
        margin = model.weights[grams].astype(np.float64).sum(0) * langid._SCALE / max(1, len(grams))

        def winner(contest):
            votes = Counter({n: 0 for n in contest.names})
            for (i, j), column, bias in zip(contest.pairs, contest.columns, contest.bias, strict=True):
                votes[contest.names[i] if margin[column] + bias > 0 else contest.names[j]] += 1
            top = max(votes.values())
            return {n for n, k in votes.items() if k == top}

        families = winner(model.families)
        assert langid.family(p) in families
        assert p in winner(model.languages[sorted(model.families.names).index(langid.family(p))])


def test_classifiers_without_both_classes(odd, none):
    for fit in (toxicity.fit, quality.fit):
        assert fit([]).scores(["x", ""]).max() < 1e-6
        assert np.allclose(fit([("a b c", 1), ("d e f", 1)]).scores(["x"]), 1.0, atol=1e-6)
    rows = toxicity.score(odd, toxicity.fit([("bad words", 1), ("good words", 0)]), name="n_chars").collect()
    assert len(rows) == len(ODD) and all(0 <= r.n_chars <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit([])).count() == 0


def test_training_sample_is_bounded_and_passes_over_nulls(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1), (99, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.training_sample(odd, labels, "toxic", F.lit(True), 100)
    assert sorted((len(t), y) for t, y in rows) == [(15, 0), (15, 0), (15, 1), (15, 1), (200_000, 0)]
    assert len(toxicity.training_sample(odd, labels, "toxic", F.lit(True), 2)) <= 2


# Pieces


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.load())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), max_size=5))
def test_pieces_are_lossless(coder, texts):
    ids, offsets = coder.encode(texts, [str(i) for i in range(len(texts))])
    assert coder.decode(ids, offsets) == texts


def test_pieces_are_drawn_in_proportion(coder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.load())
    known = {sp.id_to_piece(i): i for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)}

    def ways(x):
        if not x:
            yield ()
        for k in range(1, len(x) + 1):
            if x[:k] in known:
                for rest in ways(x[k:]):
                    yield (known[x[:k]], *rest)

    weight = {w: math.exp(sum(coder.vocabulary.weight[i] for i in w)) for w in ways("▁there")}
    n = 20_000
    ids, offsets = coder.encode(["there"] * n, [f"k{i}" for i in range(n)])
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False))
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    assert sum(abs(seen[w] / n - p / total) for w, p in weight.items()) < 0.03


def test_pieces_follow_the_row_key_alone(coder):
    texts = ["the same words again and again"] * 6
    a, oa = coder.encode(texts, list("xyxyzz"))
    rows = [tuple(a[i:j]) for i, j in zip(oa, oa[1:], strict=False)]
    assert rows[0] == rows[2] and rows[1] == rows[3] and len(set(rows)) > 1
    b, _ = pieces.Coder(pieces.load()).encode(texts[:1], ["x"])
    assert tuple(b) == rows[0]


def test_pieces_of_odd_rows(odd, none):
    model = pieces.load()
    coded = pieces.decode(pieces.encode(odd.withColumn("pieces", F.lit(1)), model), model)
    assert all(r.decoded == r.text and (r.pieces is None) == (r.text is None) for r in coded.collect())
    assert pieces.encode(none, model).count() == 0


# Personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("a.@1-+ 9.()%é0", max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_documents(docs):
    for r in docs.limit(100).collect():
        assert pii.base_spans(r.text) == brute_spans(r.text)


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.training_table())


def test_field_labels_other_lines(field):
    table = pii.training_table(200, seed=99)
    w = pii.Words.of(pii.code_points(["".join(" ".join(x for x, _ in line) + "\n" for line in table)])[0])
    truth = np.array([pii.LABELS.index(k) for line in table for _, k in line])
    found = field.label(w)
    assert (found == truth).mean() > 0.97
    # Viterbi along whole lines gives the same labels.
    e, m = field.scores(w), field.move
    starts = np.r_[np.flatnonzero(w.first), len(truth)]
    for a, b in zip(starts, starts[1:], strict=False):
        v, back = e[a] + m[0], []
        for t in range(a + 1, b):
            s = v[:, None] + m
            back.append(s.argmax(0))
            v = s.max(0) + e[t]
        k = int((v + m[:, 0]).argmax())
        for t in range(b - 1, a - 1, -1):
            assert found[t] == k
            if t > a:
                k = int(back[t - a - 1][k])


def test_all_spans_hold_the_base_spans(field):
    texts = ["mail a.b@c.de and 10.0.0.1 now", "", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "plain words only"]
    found = pii.all_spans(texts, field)
    assert [k for k, _, _ in found[0][0]] == ["email", "ip"]
    assert all(set(base) <= set(whole) for base, whole in found)
    assert [texts[2][a:b] for k, a, b in found[2][1] if k == "secret"] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert found[3] == ([], []) and found[1] == ([], [])


def test_personal_data_of_odd_rows(odd, none, field):
    rows = pii.find(odd, field).collect()
    assert len(rows) == len(ODD)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(none, field).count() == 0


# Decontamination


def brute_hits(text, items, window):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(rx, lower(text or ""))
    hit, met = set(), set()
    for item, t in items:
        x = re.findall(rx, lower(t or ""))
        for i in range(max(1, len(x) - window + 1) if x else 0):
            part = x[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    met.add(item)
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def test_windows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(rng.choice(["a", "B", "cé", "d9", "e-f", "漢"], n))
    items = [(str(i), make(int(rng.integers(0, 9)))) for i in range(12)] + [("n", None), ("z", "!!")]
    texts = [(i, make(int(rng.integers(0, 40)))) for i in range(40)] + [(99, None)]
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for window in (3, 5):
        for limit in (1 << 20, 40):
            old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, limit
            try:
                found = decontaminate.find_windows(d, b, window, limit=limit).withColumn("n_hit", decontaminate.hit_words(F.col("hit_spans"))).orderBy("doc_id").collect()
            finally:
                decontaminate.BLOCK_BYTES = old
            for r, (_, t) in zip(found, texts, strict=True):
                n, hit, met, digest, _ = brute_hits(t, items, window)
                assert (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == (n, hit, met, digest)


def test_windows_across_lanes():
    pattern = " ".join(f"needle{i}" for i in range(10))
    text = ("hay " * 2000 + pattern + " ") * 3
    found = decontaminate.Windows([("i", pattern)]).spans([decontaminate.words(text)])[0]
    assert [a for a, _ in sorted(found[0])] == [2000, 4010, 6020]


def test_windows_of_odd_rows(odd, none, spark):
    b = spark.createDataFrame([(1, "no such words here at all in any of the documents")], "item_id long, text string")
    assert decontaminate.contamination(odd, b).where("contaminated").count() == 0
    assert decontaminate.contamination(none, b).count() == 0
    assert decontaminate.contamination(odd, b.limit(0)).count() == len(ODD)
    clash = odd.withColumn("items", F.lit(1)).withColumn("hit_spans", F.lit(2))
    assert decontaminate.find_windows(clash, b).count() == len(ODD)


# Near duplicates


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=4):
    label = np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= radius
    while True:
        new = np.where(near, label[None], len(points)).min(1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints_equal_brute_force(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "one", "one two three", "A b\x0bC d\te"]
    assert [int(x) for x in simhash.fingerprints(texts)] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("flips", [3, 5, 7])
def test_trees_find_all_links(flips):
    rng = np.random.default_rng(flips)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    p = centers[rng.integers(0, 12, 1500)]
    for _ in range(flips):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64))
    p = np.unique(np.r_[p, rng.integers(0, 2**63, 500, dtype=np.uint64)])
    assert (simhash.Links(p).label == brute_components(p)).all()


@pytest.mark.parametrize("shard", [simhash.SHARD, 100, 32])
def test_shards_lose_no_link(spark, shard):
    rng = np.random.default_rng(4)
    p = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 6)).astype(np.uint64), axis=1)
    p = np.unique(np.r_[p, rng.integers(0, 2**63, 200, dtype=np.uint64)])
    fps = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    dealt = simhash.shards(fps, shard=shard)
    assert dealt.groupBy("fixed", "cell").count().agg(F.max("count")).first()[0] <= shard
    edges = simhash.local_edges(dealt)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    signed = p.view(np.int64)
    group = defaultdict(set)
    for x, k in zip(signed.tolist(), brute_components(p).tolist(), strict=True):
        group[k].add(x)
    assert all({root.get(x, x) for x in members} == {min(members)} for members in group.values())


def test_shards_stay_small_as_fingerprints_grow_many(spark):
    compared = []
    for n in (2_000, 16_000):
        p = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) % np.uint64(1 << 40))
        fps = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
        rows = simhash.shards(fps, shard=40).toArrow().to_pandas()
        held = [simhash.Links(x.to_numpy().view(np.uint64)).compared for _, x in rows.groupby(["fixed", "cell"]).fp if len(x) > 1]
        assert rows.groupby(["fixed", "cell"]).size().max() <= 40
        compared.append(sum(held))
    assert compared[1] < compared[0] * 8**1.5  # all pairs would be 64 times as many


def test_trees_compare_fewer_than_all_pairs():
    rng = np.random.default_rng(9)
    centers = rng.integers(0, 2**63, 40, dtype=np.uint64)
    p = np.unique(centers[rng.integers(0, 40, 4000)] ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    assert simhash.Links(p).compared < len(p) ** 2 / 3


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, "a"), (5, long, "b"), (None, long, "c"), (5, "another text altogether, of some words", "d"), (None, "third", "e"), (None, "third", "f"), (9, None, "g"), (8, "", "h")]
    out = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, __n string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 5, "another text altogether, of some words"), (False, 5, long), (False, 8, ""), (True, 0, "third")]
    assert {r["__n"] for r in out} < set("abcdefgh")


def test_frequent_keys_join_like_others(spark):
    left = spark.range(40_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = spread_join(left, right, "k", 40_000)
    assert out.count() == 40_000 and out.where("k = 7 and least = 0").count() == 30_000 and out.columns == ["k", "id", "least"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_component_ids_are_the_least_of_all_members(spark):
    rng = np.random.default_rng(12)
    centers = rng.integers(0, 2**63, 60, dtype=np.uint64)
    p = np.unique(centers[rng.integers(0, 60, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    fp, doc = np.repeat(p, 2), rng.permutation(2 * len(p))
    prints = spark.createDataFrame(list(zip(doc.tolist(), fp.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash._components_of(prints, 4).collect()}
    label, least = np.repeat(brute_components(p), 2), {}
    for k, d in zip(label.tolist(), doc.tolist(), strict=True):
        least[k] = min(d, least.get(k, d))
    assert found == {x: least[k] for x, k in zip(fp.view(np.int64).tolist(), label.tolist(), strict=True)}


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicate_table(odd).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {1} and len(zero) == 3
    assert [r.component_id for r in rows if r.doc_id == 3] == [3, 3]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicate_table(none).count() == 0


def test_copies_share_a_component(docs):
    rows = simhash.near_duplicate_table(docs).collect()
    least = defaultdict(lambda: math.inf)
    text = {r.doc_id: r.text for r in docs.collect()}
    for d, t in text.items():
        least[t] = min(least[t], d)
    assert all(r.component_id <= least[text[r.doc_id]] for r in rows)


# Version sketches


def test_sketches_recover_the_differing_digests():
    rng = np.random.default_rng(2)
    a, b = [], []
    for k in (0, 1, 5, 60, 700):
        common = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a.append(np.unique(np.r_[common, rng.integers(0, 2**63, k, dtype=np.uint64)]))
        b.append(np.unique(np.r_[common, rng.integers(0, 2**63, 2 * k, dtype=np.uint64)]))
    for x, y, (only_x, only_y) in zip(a, b, version_sketch.differences(a, b), strict=True):
        assert set(only_x.tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(only_y.tolist()) == set(y.tolist()) - set(x.tolist())


def brute_versions(rows):
    hashed = lambda t: xxhash.xxh64_intdigest(t, 42) ^ 1 << 63  # in the order of signed numbers
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1] or ""), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        s = [set(version_sketch.digests(x)) for x in (t, new, following)]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), dice(s[0], s[1]), dice(s[0], s[2])))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_versions_equal_brute_force(spark, docs, odd, none, parts):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), odd.select("doc_id", "text").where("doc_id = 1"), none.select("doc_id", "text")):
        found = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in version_sketch.fingerprinted(df, parts).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        expect = brute_versions([tuple(r) for r in df.collect()])
        assert len(found) == len(expect)
        for f, e in zip(sorted(found, key=key), sorted(expect, key=key), strict=True):
            assert f[:3] == e[:3] and np.allclose(f[3:], e[3:])


def test_ids_that_fill_several_places_are_split(spark):
    rows = [(5 if i % 3 else None, f"text {i}") for i in range(900)] + [(i, f"other {i}") for i in range(-50, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = Counter(r.place for r in version_sketch.in_order(df, 12).where("guest = 0").collect())
    assert len(places) > 10 and max(places.values()) < 250
    found = {(r.doc_id, r.edited_sha256, r.near_next) for r in version_sketch.fingerprinted(df, 12).collect()}
    assert found == {(d, sha, near) for d, _, sha, _, near in brute_versions(rows)}


def test_one_more_word_changes_the_paragraphs_around_it_alone():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 3000, 4000)]
    one, other = (np.array(version_sketch.digests(t), np.uint64) for t in (" ".join(words), " ".join(["new", *words])))
    assert version_sketch.likeness([one], [other])[0] > 0.95
    assert len(one) > 200
    same = version_sketch.paragraphs(b"word " * 1000 + b"end")
    assert max(len(p.split()) for p in same) <= version_sketch.LONGEST and b" ".join(same).split() == (b"word " * 1000 + b"end").split()


def test_equal_texts_have_equal_fingerprints(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = defaultdict(set)
    for r in version_sketch.fingerprinted(docs, 4).collect():
        seen[text[r.doc_id]].add(r.fingerprint)
    assert all(len(s) == 1 for s in seen.values())


# Suffix tree


def brute_scores(texts, training):
    tok = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "\0end"] for t in texts]
    c = Counter(w for t, train in zip(tok, training, strict=True) if train for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t in tok]


@pytest.mark.parametrize("hot", [100_000, 40])
def test_base_scores_equal_brute_force(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        given_ = df.withColumn("t", remainder(F.col("doc_id"), 7) != 2).collect()
        expect = brute_scores([r.text for r in given_], [r.t for r in given_])
        found = suffix_tree.scored(df, remainder(F.col("doc_id"), 7) != 2).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out) for r in found), key=key)
        theirs = sorted(((g.doc_id, *e, not g.t) for g, e in zip(given_, expect, strict=True)), key=key)
        for m, t in zip(mine, theirs, strict=True):
            assert m[:4] == t[:4] and m[5] == t[5] and math.isclose(m[4], t[4], rel_tol=1e-9, abs_tol=1e-9)


def test_tree_beats_the_base_on_held_out_texts(docs):
    rows = suffix_tree.scored(docs, remainder(F.col("doc_id"), 7) != 2).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score <= 0 for r in rows)


class BruteTree:
    """Contexts by counting every one of them, and probabilities by recursion."""

    def __init__(self, texts):
        tok = [self.tokens(t) for t in texts]
        self.words = Counter(w for t in tok for w in t)
        self.n, once = sum(self.words.values()), max(1, sum(k == 1 for k in self.words.values()))
        self.unknown = once / (self.n + 0.75 * len(self.words) + once)
        self.share = {w: (k + 0.75) / (self.n + 0.75 * len(self.words) + once) for w, k in self.words.items()}
        self.kept, depth, some = {}, 1, True
        while some and depth <= int(math.log(max(self.n, 2)) / math.log(suffix_tree.LEAST)):
            met = defaultdict(Counter)
            for t in tok:
                for i in range(depth, len(t)):
                    if depth == 1 or tuple(t[i - depth + 1 : i]) in self.kept:
                        met[tuple(t[i - depth : i])][t[i]] += 1
            some = {}
            for context, counts in met.items():
                a, twice = sum(counts.values()), {w: k for w, k in counts.items() if k > 1}
                if a < suffix_tree.LEAST or not twice:
                    continue
                q = {w: self.p(context[1:], w) for w in twice}
                rest = a - sum(twice.values())
                gain = sum(k * math.log(k / a / q[w]) for w, k in twice.items()) + (rest * math.log(rest / a / (1 - sum(q.values()))) if rest else 0)
                if 2 * gain > (len(twice) + 1) * math.log(self.n):
                    some[context] = twice, sum(twice.values()), rest + len(twice)
            self.kept |= some
            depth += 1

    @staticmethod
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "\0end"]

    def p(self, context, w):
        if not context:
            return self.share.get(w, self.unknown)
        if context not in self.kept:
            return self.p(context[1:], w)
        counts, seen, m = self.kept[context]
        return (counts.get(w, 0) + m * self.p(context[1:], w)) / (seen + m)

    def score(self, t):
        tok = self.tokens(t)
        deepest = max(map(len, self.kept), default=0)
        out = 0.0
        for i, w in enumerate(tok):
            context = next((c for k in range(min(i, deepest), 0, -1) if (c := tuple(tok[i - k : i])) in self.kept), ())
            out += math.log10(self.p(context, w))
        return out


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_tree_equals_brute_force(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "HOT_RUNS", hot)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = df.withColumn("t", remainder(F.col("doc_id"), 7) != 2).collect()
        tree = BruteTree([r.text for r in rows if r.t])
        if len(rows) > 100:
            assert max(map(len, tree.kept)) > 1
        expect = sorted((r.doc_id is None, r.doc_id or 0, tree.score(r.text)) for r in rows)
        found = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in suffix_tree.scored(df, remainder(F.col("doc_id"), 7) != 2).collect())
        for f, e in zip(found, expect, strict=True):
            assert f[:2] == e[:2] and math.isclose(f[2], e[2], rel_tol=1e-5, abs_tol=1e-5)


def test_tree_distributions_sum_to_one(docs):
    tree = BruteTree([r.text for r in docs.limit(60).collect()])
    for context in [(), *list(tree.kept)[::50]]:
        assert math.isclose(sum(tree.p(context, w) for w in tree.words) + tree.p(context, "never met"), 1)


def test_frequent_contexts_are_dealt_by_next_word(spark, monkeypatch):
    texts = [f"the w{i % 90} x{i % 7} the the" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = BruteTree(texts)
    found = {r.doc_id: r.score for r in suffix_tree.scored(df, F.lit(True)).collect()}
    assert all(math.isclose(found[i], tree.score(t), rel_tol=1e-5) for i, t in enumerate(texts[:200]))


def test_packed_counts_unpack():
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 50, 999).astype(np.uint64) for _ in range(3)] + [rng.integers(1, 1 << 20, 999)]
    x[1] = x[0] * np.uint64(3)
    known = np.arange(0, 200, 3).astype(np.uint64)
    for some in (known, known[:0]):
        back = suffix_tree.unpack(suffix_tree.pack(*x, some), some)
        assert sorted(zip(*(c.tolist() for c in back), strict=True)) == sorted(zip(*(c.tolist() for c in x), strict=True))


def test_a_table_finds_its_keys():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    table = suffix_tree.Table(key, np.arange(len(key), dtype=float))
    value, there = table.find(np.r_[key, key + np.uint64(1)])
    assert there[: len(key)].all() and (value[: len(key)] == np.arange(len(key))).all()
    assert there[len(key) :].sum() == np.isin(key + np.uint64(1), key).sum()
    assert not suffix_tree.Table(key[:0], np.zeros(0)).find(key)[1].any()


def test_packed_places_unpack():
    rng = np.random.default_rng(3)
    key, rid = np.sort(rng.integers(0, 90, 700).astype(np.uint64)), rng.integers(5 << 33, (5 << 33) + 20, 700)
    order = np.lexsort((rid, key))
    keys, many, rows, k = suffix_tree.unpack_places(suffix_tree.pack_places(key[order], rid[order]))
    found = {(x, y): z for x, y, z in zip(np.repeat(keys, many).tolist(), rows.tolist(), k.tolist(), strict=True)}
    assert found == Counter(zip(key.tolist(), rid.tolist(), strict=True))


def test_sorted_keys_are_packed_by_their_differences():
    key = np.sort(np.random.default_rng(6).integers(0, 1 << 58, 1 << 14, np.uint64))
    block = suffix_tree.pack_places(key, np.full(len(key), 7 << 33))
    assert len(block) < 7 * len(key) and (suffix_tree.unpack_places(block)[0] == key).all()


def test_tokens_that_go_on_are_counted_as_whole_texts_are(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(" ".join(rng.choice(list("abcdefgh"), 30)),) for _ in range(200)], "text string")
    (b, c), every = suffix_tree.hashes(["b c"])[0][:2], np.full(1 << 13, 255, np.uint8)
    bits = suffix_tree.no_bits(0)
    for key in (suffix_tree.as_context(b[None]), suffix_tree.longer(c[None], b[None])):  # the context b, and c after it
        for probe in range(2):
            at = suffix_tree._at(key, probe, 8 * len(bits))[0]
            bits[at >> 3] |= np.uint8(1 << (at & 7))
    none = np.zeros(0, np.uint64)
    given_ = spark.sparkContext.broadcast((*map(suffix_tree.packed, (every, bits, every)), none, none))
    few = suffix_tree.going_on(df, spark.sparkContext.broadcast(suffix_tree.packed(bits)), 2, 4)
    assert few.columns == ["tokens"] and 0 < sum(len(h) for h, _ in suffix_tree.tokens(iter(few.toArrow().to_batches()))) < 200 * 31 * 0.7
    whole, part = (sorted(map(tuple, suffix_tree.level_counts(x, 2, given_, 3).collect())) for x in (df, few))
    assert whole == part and len(whole) == 8  # those met once after b, and totals, are not dealt
    texts = [r.text for r in df.collect()]
    assert sum(r[3] for r in whole) == sum(len(re.findall("(?<=. b )c", t)) for t in texts)


def test_a_text_is_read_once_for_all_levels(spark):
    df = spark.createDataFrame([("a b A  é" * k,) for k in range(1, 400)] + [(None,), ("",)], "text string")
    blocks = suffix_tree.token_blocks(df)
    assert blocks.columns == ["tokens"]
    whole, part = (sorted(sum((h.tolist() for h, _ in suffix_tree.tokens(iter(x.toArrow().to_batches()))), [])) for x in (df, blocks))
    assert whole == part and len(whole) == sum(3 * k + 2 for k in range(1, 400)) + 2
    counts = {r.key: r.n for r in suffix_tree.corpus_counts(blocks, 3).collect()}
    assert counts == Counter(np.array(whole, np.uint64).view(np.int64).tolist())


def test_pairs_of_blocks_are_counted_as_those_of_texts(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(" ".join(rng.choice(list("abcdefghijklmnopqrst"), 40)),) for _ in range(300)] + [("a b",), (None,)], "text string")
    words = suffix_tree.hashes(["a b c d e"])[0][:5]
    common, bits = suffix_tree.no_bits(0), suffix_tree.no_bits(0)
    for k in range(2):  # b and c are not among the common words
        at = suffix_tree._at(words[[0, 3, 4]], k, 8 * len(common))
        np.bitwise_or.at(common, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for frequent in (words[:0], words[:1]):  # the counts after a frequent word are dealt by next word too
        given_ = spark.sparkContext.broadcast((*map(suffix_tree.packed, (common, bits, bits)), frequent, words[2:3]))
        texts, blocks = (sorted(map(str, suffix_tree.level_counts(x, 1, given_, 3).groupBy("run", "context", "suffix").agg(F.sum("n")).collect())) for x in (df, suffix_tree.token_blocks(df)))
        assert texts == blocks and len(texts) > 50


def test_both_bits_of_a_key_are_in_one_word(spark):
    key = np.random.default_rng(9).integers(0, 1 << 64, 30_000, np.uint64)
    df = spark.createDataFrame([(k,) for k in key[:20_000].view(np.int64).tolist()], "key long")
    bits = suffix_tree.bits_of(df, suffix_tree.no_bits(20_000))
    one, other = (suffix_tree._at(key, k, 8 * len(bits)) for k in range(2))
    assert (one >> 6 == other >> 6).all()
    assert (suffix_tree.holds(bits, key) == (bits[one >> 3] >> (one & 7) & bits[other >> 3] >> (other & 7) & 1).astype(bool)).all()
    assert suffix_tree.holds(bits, key[:20_000]).all() and suffix_tree.holds(bits, key[20_000:]).mean() < 0.03


def test_parts_are_ranges_of_keys():
    key = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 5000, np.uint64))
    for parts in (1, 3, 64):
        ends = suffix_tree._parts(key, parts)
        assert ends[0] == 0 and ends[-1] == 5000 and (np.diff(ends) >= 0).all() and np.diff(ends).max() < 2 * 5000 / parts + 60


@given(st.lists(st.text(st.sampled_from("aabbB \t\n\x85é日"), max_size=120), max_size=6))
def test_tokens_are_hashed_alike(texts):
    h, sizes = suffix_tree.hashes(texts)
    words = [w for t in texts for w in BruteTree.tokens(t)]
    assert sizes.tolist() == [len(BruteTree.tokens(t)) for t in texts]
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_no_documents_or_no_training(none, odd):
    assert suffix_tree.scored(none, F.lit(True)).count() == 0
    rows = suffix_tree.scored(odd, F.lit(False)).collect()
    assert len(rows) == len(ODD) and {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0}
    assert {round(r.base_score, 9) for r in rows} == {0.0}


def test_contexts_are_whole_words_however_many(spark):
    # More words than the classes tell apart, alike in number: pairs, and third words that only the two before tell.
    many = range(600)
    rows = [[f"a{i} b{i}" for i in many] * 10, [f"{x}{i} mid{i} {x}{i}end" for i in range(200) for x in ("l", "r")] * 40]
    rng = np.random.default_rng(5)
    texts = [" ".join(x[i] for i in part) for x in rows for part in np.array_split(rng.permutation(len(x)), 100)]
    held = [" ".join(f"a{i} b{i}" for i in many), " ".join(f"a{i} b{(i + 1) % 600}" for i in many), " ".join(f"l{i} mid{i} l{i}end" for i in range(200)), " ".join(f"l{i} mid{i} r{i}end" for i in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + held)], "doc_id long, text string")
    score = {r.doc_id - len(texts): r.score for r in suffix_tree.scored(df, F.col("doc_id") < len(texts)).collect()}
    assert score[0] > score[1] + 600 and score[2] > score[3] + 100


def test_word_contexts_score_alike_from_either_table(spark, monkeypatch):
    texts = ["x y z", "x y x y", "y x", "x z z y"] * 30
    vocabulary = ["x", "y", "z"]
    ends = [f"x {w}" for w in vocabulary]
    for hot in (0, 1000):
        monkeypatch.setattr(suffix_tree, "HOT_RUNS", hot)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["x"] + ends)], "doc_id long, text string")
        rows = {r.doc_id - len(texts): r.score for r in suffix_tree.scored(df, F.col("doc_id") < len(texts)).collect()}
        if hot:
            assert all(math.isclose(rows[k], before[k], rel_tol=1e-9) for k in before)
        before = rows
