"""Language ID, toxicity and the pipeline: held-out accuracy, normalisation, edge rows."""

import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tallyfold.llm import language_id, mixing, piece_codec, toxicity
from tallyfold.llm.queries import piece_model

from .conftest import ordered, result

SF = os.environ.get("TALLYFOLD_TEST_DATA", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


WORDS = {"aba": 3, "abb": 1, "ba": 5, "b": 2, "cab": 1, "aabc": 4}


def brute_kneser_ney(context, nxt, order=4, d=0.75):
    """p(nxt | context) by the recursion over counts of strings, for nxt a symbol or None for an unseen letter."""
    seen = [("\x01" + w + "\x01", n) for w, n in WORDS.items()]
    grams = lambda n: [(s[k : k + n], k, c) for s, c in seen for k in range(len(s) - n + 1) if k + n > 1]
    symbols = {s[k] for s, _ in seen for k in range(1, len(s))}

    def count(g, top):
        if top or g[0] == "\x01" and len(g) > 1:
            return sum(c for x, _, c in grams(len(g)) if x == g)
        return len({x[0] for x, _, _ in grams(len(g) + 1) if x[1:] == g})

    def p(ctx, top):
        n = len(ctx) + 1
        after = {x: count(ctx + x, top) for x in symbols}
        total, kinds = sum(after.values()), sum(1 for c in after.values() if c)
        lower = p(ctx[1:], False) if ctx else 1 / (len(symbols) + 1)
        if not total:
            return lower
        return max(after.get(nxt, 0) - d, 0) / total + d * kinds / total * lower

    ctx = ("\x01" + context)[-(order - 1) :]
    return p(ctx, len(ctx) == order - 1)


def test_kneser_ney_equals_its_recursion_and_sums_to_one():
    tables = language_id.fit_counts(list(WORDS), np.array(list(WORDS.values())))
    rows = pd.concat([t.assign(n=k + 1, lang="x") for k, t in enumerate(tables)])
    model = language_id.LanguageModel.of(["x"], rows)
    assert model.spread is None
    for k in range(4):  # as exact as the recursion
        model.logp[k] = model.logp[k].astype(float)

    def logp(context, nxt):
        full, part = (model.word_scores([w])[0, 0] for w in (context + nxt, context))
        ends = [brute_kneser_ney(w, "\x01") for w in (context + nxt, context)]
        return full - np.log(ends[0]) - (part - np.log(ends[1]))

    for context in ("", "a", "ab", "c", "aba", "abab", "q", "aq"):
        total = brute_kneser_ney(context, None) + sum(brute_kneser_ney(context, c) for c in "abc\x01")
        assert abs(total - 1) < 1e-9
        for c in "abcz":
            assert abs(logp(context, c) - np.log(brute_kneser_ney(context, c if c != "z" else None))) < 1e-5, (context, c)
        assert abs(model.word_scores([context])[0, 0] - sum(np.log(brute_kneser_ney(context[:k], (context + "\x01")[k])) for k in range(len(context) + 1))) < 1e-4


def test_tables_of_an_order_sum_to_one():
    """Over the lowest order, the unseen symbol included, within 1e-9."""
    unigrams = language_id.fit_counts(list(WORDS), np.array(list(WORDS.values())))[0]
    assert abs(np.exp(unigrams["logp"]).sum() - 1) < 1e-9


def test_letters_are_no_numerals():
    assert language_id.LETTERS.findall("² ½ Ⅷ ٣ 12 _ a²b é ก็ न्") == ["a", "b", "é", "ก็", "न्"]


@needs_tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


@needs_tables
def test_language_edge_rows(spark, docs, texts):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language_id.classify(docs, model).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (2, 3, 8, 10):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[4]["lang_pred"] in model.langs


@needs_tables
def test_rejection_beside_a_one_row_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "Selten ist dieses eine Wort hier zu lesen.", "xx")], docs.schema)
    model = language_id.fit(docs.filter("lang <> 'de'").unionByName(rare))
    assert model.langs == ["en", "es", "fr", "xx"] and np.isfinite(model.limit) and np.isfinite(model.spread).all()
    gibberish = spark.createDataFrame([(k, " ".join(f"{w}qzx{w[::-1]}kj" for w in ("vwq", "jzk", "qqxz", "wvk")) * k, "en") for k in (1, 5, 20)], docs.schema)
    german = docs.filter("lang = 'de' and length(text) > 100")  # a few letters prove nothing
    for unknown in (gibberish, german):
        assert language_id.classify(unknown, model).agg({"rejected": "min"}).first()[0]
    known = language_id.classify(docs.filter("lang <> 'de'"), model).toPandas()
    assert known.rejected.mean() < 0.01
    assert not language_id.classify(rare, model).first()["rejected"]


def test_language_without_labels(docs, empty, texts):
    got = language_id.language_id(docs.drop("lang").selectExpr("*", "cast(null as string) AS lang"))
    assert {r["lang_pred"] for r in got.collect()} == {"und"} and got.count() == len(texts)
    assert language_id.language_id(empty).count() == 0


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    got = scored.join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    toxic = held.toxic == 1
    assert (held.score[toxic].to_numpy()[:, None] > held.score[~toxic].to_numpy()[None]).mean() > 0.85
    assert (held.predicted[~toxic] == 0).mean() > 0.95
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    found = scored.filter("predicted = 1 and size(offending) > 0").join(docs, "doc_id").first()
    assert all(0 <= s["start"] < s["end"] <= len(found["text"]) and s["p"] >= 0.5 for s in found["offending"])


def test_toxicity_edge_rows(spark, docs, empty, texts):
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 0), (3, None), (None, 1), (6, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert result(got, "doc_id") == ordered([(i,) for i, *_ in texts])
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = toxicity.toxicity(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_noisy_or():
    m = toxicity.ToxicityModel()
    p = np.array([0.3, 0.5, 0.1])
    z = m.logit(np.log(p / (1 - p)))
    assert abs(1 / (1 + np.exp(-z)) - (1 - np.prod(1 - p))) < 1e-9


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(3)
    doc_of = np.sort(rng.integers(0, 12, 40))
    sent_of, feat = rng.integers(0, 40, 150), rng.integers(0, 9, 150)
    toxic, fitted = rng.random(12) < 0.4, rng.random(12) < 0.8
    w, b = rng.standard_normal(9), -1.0
    loss, grad = toxicity.loss_and_gradient(w, b, sent_of, feat, doc_of, toxic, fitted)
    p = 1 / (1 + np.exp(-(b + np.array([w[feat[sent_of == k]].sum() for k in range(40)]))))
    joined = np.array([1 - np.prod(1 - p[doc_of == d]) for d in range(12)]).clip(1e-12, 1)
    want = -np.mean(np.where(toxic, np.log(joined), np.log1p(-joined))[fitted & np.isin(np.arange(12), doc_of)])
    if np.isin(np.flatnonzero(fitted), doc_of).all():
        assert abs(loss - want - toxicity.PENALTY / 2 * (w**2).sum()) < 1e-9
    for k in range(10):
        step = np.zeros(10)
        step[k] = 1e-6
        up, down = (toxicity.loss_and_gradient(w + s * step[:9], b + s * step[9], sent_of, feat, doc_of, toxic, fitted)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-6


def test_scores_equal_a_plain_noisy_or(spark, docs, texts):
    """Each row against sentences, words and prefixes spelled out."""
    model = toxicity.ToxicityModel({"fox": 2.0, "quic*": 1.5, "word*": 0.7, "sea": -1.0, "apache": 9.0}, -4.0, -1.0)
    want = []
    for i, t, *_ in texts:
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", (t or "").lower()):
            words = {w for w in re.findall(r"[^\W\d_]+", m.group())}
            if words:
                z = -4.0 + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:n] + "*", 0) for n in (4, 5, 6, 7, 8) if n <= len(w)) for w in words)
                p = 1 / (1 + np.exp(-z))
                clean *= 1 - p
                spans += [(m.start(), m.end())] * int(p >= 0.5)
        odds = np.log((1 - clean) / clean) if 0 < clean < 1 else np.log(1e-12) if clean == 1 else 700.0
        want.append((i, round(float(1 / (1 + (3 / 7) * np.exp(-np.clip(odds + 1.0, -500, 500)))), 6), spans))
    got = [(r["doc_id"], round(r["score"], 6), [(s["start"], s["end"]) for s in r["offending"]]) for r in toxicity.score(docs, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.toPandas()
    one = corpus_pipeline.identify_language(spark, docs, SF).cache()
    assert tuple(one.columns) == corpus_pipeline.COLUMNS and one.count() >= 0.99 * len(kept)
    two = corpus_pipeline.drop_copies(spark, one, SF).cache()
    first = one.toPandas()
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.groupby("text").doc_id.max())
    three = corpus_pipeline.drop_near_copies(spark, two, SF).cache()
    assert set(r["doc_id"] for r in three.collect()) <= set(r["doc_id"] for r in two.collect())
    four = corpus_pipeline.mix(spark, three, SF).cache()
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(three).collect() if r["copies"]}
    assert four.toPandas().groupby("doc_id").size().to_dict() == want
    five = corpus_pipeline.encode(spark, four, SF)
    assert sorted(five.toPandas().n_tokens) == sorted(piece_codec.piece_digests(four, piece_model()).toPandas().n_tokens)


def test_pipeline_decides_by_row(spark):
    words = [f"word{k * k % 89} of line{k}" for k in range(200)]
    a, b, c = " ".join(words), " ".join(words[::-1]), " ".join(f"{w} else" for w in words)
    # repeated rows, rows without an id, one id with two texts
    rows = [(1, a), (1, a), (2, a), (2, a), (2, b), (None, c), (None, c), (None, a), (3, b), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    assert found(corpus_pipeline.drop_copies(spark, docs, SF)) == sorted([(2, a), (3, b), (0, c), (4, "")])
    assert found(corpus_pipeline.drop_near_copies(spark, docs, SF)) == sorted([(1, a), (2, b), (0, c), (4, "")])
    copies = docs.filter("text <> ''")
    mixed = corpus_pipeline.mix(spark, copies, SF).count()
    assert mixed == mixing.mix_sources(copies).agg({"copies": "sum"}).first()[0]


def test_pipeline_stages_on_edge_rows(spark, docs, empty, texts):
    for table in (docs, empty):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        out.collect()
    assert corpus_pipeline.drop_copies(spark, docs, SF).count() <= len(texts)
