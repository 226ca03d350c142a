"""Spelling variants, ranked search and token counts against brute force and the library."""

import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import lexical_search, spelling, token_counts
from tallyfold.llm.queries import lose_letters, word_tokenizer

from .conftest import ordered, result


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- token counts ----
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def pre_tokens():
    with open(word_tokenizer(), "rb") as f:
        return token_counts.PreTokens(f.read())


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(docs, texts, library):
    want = [(i, len((t or "").encode()), n_tokens(library, t), n_tokens(library, t) > 2048) for i, t, *_ in texts]
    assert result(token_counts.token_counts(docs, word_tokenizer()), "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered(want)
    limited = token_counts.token_counts(docs, word_tokenizer(), max_tokens=1)
    assert result(limited, "doc_id", "over_limit") == ordered([(w[0], w[2] > 1) for w in want])


def test_token_counts_without_frequent_ones(docs, texts, library, monkeypatch):
    """All pre-tokens meet their counts in the shuffled join."""
    monkeypatch.setattr(token_counts, "HOT_SHARE", 0)
    monkeypatch.setattr(token_counts, "LONG_SHARE", 0)
    got = token_counts.token_counts(docs, word_tokenizer())
    assert result(got, "doc_id", "n_tokens") == ordered([(i, n_tokens(library, t)) for i, t, *_ in texts])


SPECIAL = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "<|endof text|>"]


@pytest.mark.parametrize("text", [*SPECIAL, "İstanbul ΣΑΣ Ǆ ﬁ é Å", "don't I'LL '’s", "x" * 5000, "\x00\x1c\x85\xa0 　a", "½ ² Ⅷ 123", "É́ ªºµ×÷ß"])
def test_pre_tokens_of_odd_texts(pre_tokens, library, text):
    assert sum(n * pre_tokens.pieces(p) for p, n in pre_tokens.frequencies(text).items()) == n_tokens(library, text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("  aAbZz'sntéÉßÿ×0129.,<|>_-\n\t\xa0日😀́Σσ")), max_size=40) | st.text(max_size=20))
def test_pre_tokens_of_any_text(pre_tokens, library, text):
    assert sum(n * pre_tokens.pieces(p) for p, n in pre_tokens.frequencies(text).items()) == n_tokens(library, text)


def test_other_tokenizers(spark, docs, texts):
    """One whose pre-tokens hold white space is cut whole, not at white space; odd special tokens are refused."""
    import os

    from tokenizers import Tokenizer

    other = os.path.join(os.path.dirname(word_tokenizer()), "byte_bpe_50k.json")
    if not os.path.exists(other):
        pytest.skip("no other tokenizer")
    lib = Tokenizer.from_file(other)
    some = docs.filter("doc_id < 7")
    want = [(i, n_tokens(lib, t)) for i, t, *_ in texts if i is not None and i < 7]
    assert result(token_counts.token_counts(some, other), "doc_id", "n_tokens") == ordered(want)
    with open(word_tokenizer()) as f, pytest.raises(ValueError):
        token_counts.PreTokens(re.sub(r'"lstrip": ?false', '"lstrip":true', f.read()).encode())


def test_token_counts_of_nothing(empty):
    assert token_counts.token_counts(empty, word_tokenizer()).count() == 0


# ---- spelling ----
def counted(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, min_chars=5, min_count=3, ratio=2):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    of = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(of[w]), words.get(form[w])))
    return rows


COLS = ("word", "form", "root", "n", "n_near", "form_n")
TYPOS = [
    (1, "spelling " * 40 + "speling " * 9 + "spellling " * 8 + "spelking " * 4 + "speking " * 3 + "peking " * 3, None, None),
    (2, "Àpple ápple " * 3 + "äpple " * 7 + "apple APPLE " * 10 + "aaaaa " * 5 + "aaaaaa " * 11 + "aaaaaaa " * 30, None, None),
    (3, "bäbel babel bebel bibel " * 3 + "babel " * 3 + "spel" * 800 + " " + ("spel" * 800 + "x ") * 7 + ("spel" * 800 + " ") * 2, None, None),
    (None, "tie11words " + "wordd " * 3 + "wordb wordc " * 6 + "worda " * 3, None, None),
]


def test_variants(spark, docs, texts):
    for rows, df in ((TYPOS, spark.createDataFrame([r[:2] for r in TYPOS], "doc_id long, text string")), (texts, docs)):
        plain = Counter(w for _, t, *_ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)))
        assert result(spelling.spelling_variants(spelling.word_counts(df)), *COLS) == ordered(variants(plain))
        lost = spelling.word_counts(df, lose_letters)
        assert result(lost, "word", "n") == ordered(counted(rows).items())
        assert result(spelling.spelling_variants(lost), *COLS) == ordered(variants(counted(rows)))


def test_chain_of_forms(spark):
    """Each word points to the next; all end at the last."""
    words = [("a" * (5 + k), 3 * 2**k) for k in range(40)]
    df = spark.createDataFrame(words, "word string, n long")
    assert result(spelling.spelling_variants(df), *COLS) == ordered(variants(dict(words)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abÿ", max_size=9), max_size=12))
def test_keys(words):
    of, keys = spelling.delete_keys(words)
    found = {}
    for k, key in zip(of, keys):
        found.setdefault(words[k], []).append(key)
    name = {}
    for w in set(words):
        shared = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
        assert len(set(found[w])) == len(shared)
        name[w] = (shared, set(found[w]))
    for a in name:
        for b in name:
            assert len(name[a][0] & name[b][0]) == len(name[a][1] & name[b][1])


def test_keys_of_a_long_word():
    of, keys = spelling.delete_keys(["ab" * 100_000, "ab" * 99_999 + "a", "xyzzy"])
    assert len(of) == 200_001 + 200_000 + 5 and keys[1] in set(keys[of == 0])


def test_variants_of_nothing(empty, spark):
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
    alone = spark.createDataFrame([("single", 5), ("other", 2), ("tiny", 9)], "word string, n long")
    assert result(spelling.spelling_variants(alone), *COLS) == [("single", None, "single", 5, 0, None)]


# ---- search ----
TERM = re.compile(lexical_search.TERM_PATTERN)


def ranked(documents, items, limit=20):
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in documents]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall(lowered(text))), []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((i, score))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, k + 1, i, s) for k, (i, s) in enumerate(scored[:limit])]
    return out


ITEMS = [(1, "the quick brown fox"), (1, "the quick brown fox"), (2, "License, LICENSED under the the the license"), (3, None), (4, "???"), (None, "word5 of the sea 12"), (5, "nosuchterm"), (6, "éàü 日本 small"), (7, "word1 " * 3 + "fox fox jumps over lazy dogs")]
HITS = ("item_id", "rank", "doc_id", "score")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in ITEMS], "item_id long, text string, score int, term string")


def test_search(docs, texts, items, monkeypatch):
    want = ordered(ranked([(i, t) for i, t, *_ in texts], list(dict.fromkeys(ITEMS))))
    assert len(want) > 20
    assert result(lexical_search.lexical_search(docs, items), *HITS) == want
    few = ordered(ranked([(i, t) for i, t, *_ in texts], list(dict.fromkeys(ITEMS)), 2))
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 2)
    monkeypatch.setattr(lexical_search, "QUERIES_A_BLOCK", 3)
    assert result(lexical_search.lexical_search(docs, items, 2), *HITS) == few


def test_one_index_many_searches(spark, docs, texts, items, tmp_path):
    index = lexical_search.build_index(docs, path=str(tmp_path / "index"))
    for part in (items, items.filter("item_id = 2")):
        asked = [(r["item_id"], r["text"]) for r in part.distinct().collect()]
        assert result(lexical_search.search(index, lexical_search.numbered_queries(part)), *HITS) == ordered(ranked([(i, t) for i, t, *_ in texts], asked))
    assert result(lexical_search.search(spark.read.parquet(str(tmp_path / "index")), lexical_search.numbered_queries(items), 1), *HITS) == ordered(ranked([(i, t) for i, t, *_ in texts], list(dict.fromkeys(ITEMS)), 1))


def test_equal_scores_go_by_id(spark):
    rows = [(k, "alpha beta gamma" if k % 3 else "delta") for k in range(200, 0, -1)] + [(None, "alpha beta gamma"), (7, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "alpha gamma")], "item_id long, text string")
    got = result(lexical_search.lexical_search(df, asked), *HITS)
    assert got == ordered(ranked(rows, [(1, "alpha gamma")]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.integers(0, 30), st.integers(1, 50), min_size=1), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 5))
def test_best_of_shard(lists, limit):
    total = Counter()
    for held, weight in lists:
        for place, share in held.items():
            total[place] += weight * share
    cursors = [(sorted(h), [h[p] for p in sorted(h)], w) for h, w in lists]
    assert sorted(lexical_search.best_of_shard(cursors, limit)) == sorted(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit])


def test_search_of_nothing(docs, empty, items):
    assert lexical_search.lexical_search(empty, items).count() == 0
    assert lexical_search.lexical_search(docs, items.filter("item_id = 99")).count() == 0


def test_packed_numbers():
    import numpy as np

    for top in (0, 255, 256, 1 << 16, 1 << 40):
        a = np.array([0, 1, top], np.int64)
        assert (lexical_search.unpack(lexical_search.pack(a)) == a).all()
