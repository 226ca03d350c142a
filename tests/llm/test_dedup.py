"""Suffix, exact, line and near-duplicate operators against brute force, edge rows included."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import exact_dedup, line_dedup, near_dedup, queries, simhash, suffix_dedup
from tallyfold.llm.blind_trie import BlindTrie, equal_groups

from .conftest import ordered, result

LAST = 1 << 62


def brute_suffix(texts, length=50):
    first: dict[bytes, int] = {}
    data = [(LAST if i is None else i, i, (t or "").encode()) for i, t, *_ in texts]
    for rank, _, b in sorted(data, key=lambda x: x[0]):
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], rank)
    out = []
    for rank, i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 60_000}, {"shard_bytes": 60_000, "hot_contexts": 1}, {"shard_bytes": 20_000, "fan": 4, "hot_contexts": 1}])
def test_suffixes(docs, texts, sizes):
    got = suffix_dedup.suffix_dedup(docs, with_text=True, **sizes)
    assert result(got, *SUFFIX) == brute_suffix(texts)
    for r in got.collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffixes_of_repetitive_texts(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ab ") for _ in range(400))
    texts = [(k, base[a : a + rng.randint(0, 200)] + "xyz" * rng.randint(0, 40) + "a" * rng.randint(0, 130)) for k in range(60) for a in [rng.randint(0, 300)]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for sizes in ({"shard_bytes": 2000}, {"shard_bytes": 700, "fan": 2, "hot_contexts": 3}):
        assert result(suffix_dedup.suffix_dedup(df, **sizes), *SUFFIX) == brute_suffix(texts)


def colliding_pair():
    """Two texts without a common 50-byte string whose polynomial hashes modulo 2^64 agree (Thue-Morse arrangement)."""
    rng = random.Random(7)
    grams = ["".join(rng.choice("abcdefghij") for _ in range(suffix_dedup.GRAM)) for _ in range(4000)]
    least = lambda g: int(suffix_dedup.gram_hashes(np.frombuffer(g.encode(), np.uint8), suffix_dedup.GRAM)[0])
    gram = min(grams, key=least)
    block = lambda k, swap: f"{gram}{chr(65 + k // 32)}{chr(65 + k % 32)}{'pq'[(k.bit_count() + swap) % 2]}"
    return ["".join(block(k, swap) for k in range(1024)) for swap in (0, 1)]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 20_000])
def test_equal_hashes_of_different_bytes_stay_apart(spark, shard_bytes):
    a, b = colliding_pair()
    assert [len(x) for x in (a, b)] == [27_648] * 2 and not {a[k : k + 50] for k in range(len(a) - 49)} & {b[k : k + 50] for k in range(len(b) - 49)}
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(suffix_dedup.string_hashes(data, np.array([0, len(a)]), np.array([len(a)] * 2)).tolist())) == 1
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, b)], "doc_id long, text string").repartition(4)
    for hot in (1 << 30, 1):
        got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(df, shard_bytes=shard_bytes, hot_contexts=hot).collect()}
        assert got == {1: 0, 2: 0, 3: 27_648, 4: 27_648}


def test_hash_classes_are_decided_by_bytes():
    text = np.frombuffer(b"aaXbbYaaXbbZ", np.uint8)
    begin, n = np.array([0, 3, 6, 9, 0]), np.array([3, 3, 3, 3, 2])
    same = np.zeros(5, np.uint64)
    order, new = suffix_dedup.equal_classes(same, same, begin, n, text)
    assert (order.tolist(), new.tolist()) == ([4, 0, 2, 1, 3], [True, True, False, True, True])


def test_a_hot_anchor_and_a_row_repeated_often(spark):
    line = "    " * 6 + "a line that very many of these documents hold, as it were"
    rows = [(k, f"{k * k} {line} {k * 7919}") for k in range(4000)] + [(5000, "the same row again and again, of more than fifty bytes of text")] * 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = suffix_dedup.suffix_dedup(df, shard_bytes=100_000, hot_contexts=500)
    assert result(got, *SUFFIX) == brute_suffix(rows)


def test_rows_shuffled_grow_with_the_input(spark):
    rows = [(k, f"{k * k % 977} of the {k * 31 % 1009} and {k}. " * 40) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.monotonically_increasing_id())
    for n, hops in ((8, 2), (64, 4)):
        shards = df.selectExpr("doc_id", "text", f"cast(id % {n} as int) AS shard").groupBy("shard")
        bits = n.bit_length()
        assert len(suffix_dedup._hops(bits, 4)) == hops
        assert suffix_dedup.name_packets(shards, bits, 4).count() <= 4 * n


def test_suffixes_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=9, max_size=9).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=40))
def test_trie_orders_and_groups(strings):
    trie = BlindTrie()
    for k, s in enumerate(strings):
        trie.insert(s, k)
    groups = trie.ordered()
    assert [strings[g[0]] for g in groups] == sorted(set(strings))
    assert all(len({strings[k] for k in g}) == 1 for g in groups)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.text("ab", min_size=30, max_size=30)), min_size=1, max_size=30), st.data())
def test_equal_groups(strings, data):
    strings = strings + [data.draw(st.sampled_from(strings)) for _ in range(5)]
    text = np.frombuffer("".join(s for _, s in strings).encode(), np.uint8)
    member, cls = equal_groups(np.array([g for g, _ in strings]), np.arange(len(strings)) * 30, 30, text)
    got, want = {}, {}
    for m, c in zip(member, cls):
        got.setdefault(c, set()).add(int(m))
    for k, s in enumerate(strings):
        want.setdefault(s, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_tries_get_only_what_parts_late(monkeypatch):
    """Strings that part within five words are told apart by the quicksort; the tries get the others; classes equal brute force."""
    rng = random.Random(9)
    head = bytes(rng.choices(b"ab", k=24))
    strings = [head + bytes(rng.choices(b"ab", k=16)) + b"c" * 10 for _ in range(300)]
    strings += [b"d" * 40 + bytes(rng.choices(b"ab", k=10)) for _ in range(200)] + strings[:50]
    tried = []
    insert = BlindTrie.insert
    monkeypatch.setattr(BlindTrie, "insert", lambda self, s, k: (tried.append(s), insert(self, s, k)))
    member, cls = equal_groups(np.zeros(len(strings), int), np.arange(len(strings)) * 50, 50, np.frombuffer(b"".join(strings), np.uint8))
    got, want = {}, {}
    for m, c in zip(member, cls):
        got.setdefault(c, set()).add(int(m))
    for k, s in enumerate(strings):
        want.setdefault(s, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert len(tried) == 200


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact(docs, texts, digest_all):
    got = exact_dedup.exact_dedup(docs, digest_all=digest_all)
    groups = {}
    for i, t, *_ in texts:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in texts:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    assert result(got, "doc_id", "keep_id", "group_size", "kept") == ordered(want)
    digests = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in texts}
    assert {r["text_sha256"] for r in got.collect()} - {None} <= digests
    assert not digest_all or {r["text_sha256"] for r in got.collect()} == digests


def test_registered_groups_come_from_the_refinement(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    grouped = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df: grouped.append(df) or df)
    got = queries.op4_exact_dedup(spark, str(tmp_path))
    (plan,) = [df._jdf.queryExecution().optimizedPlan().toString() for df in grouped]
    # the groups: rows that both sieves let through, by the hash of the whole text
    assert plan.count("bitmap_construct_agg") == 3  # by length; by prefix, of those that the length lets through
    assert "octet_length" in plan and "xxhash64" in plan and "sha2" in plan
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in physical and "Arrow" not in physical
    # rows that are alone are hashed for output only and join nothing
    together, alone = got._jdf.queryExecution().optimizedPlan().children().apply(0), got._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "LeftOuter" in together.toString() and "group_size" not in alone.toString().split("Filter")[1]
    survive = {r["doc_id"] for r in exact_dedup.survivors(docs).filter("shared").collect()}
    assert {4, 5, 2, 3, None} <= survive and not {1, 6, 9, 11} & survive  # 7 and 12 share length and prefix


def test_exact_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_sieve_misses_nothing(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text")
    got = exact_dedup.exact_dedup(df)
    assert got.filter("kept").count() == 1500 and got.filter("group_size < 2").count() == 0


def brute_chunks(lines):
    """Chunk ends by the sum of the last three line hashes, each times a power, folded and divisible by four."""
    h, out, start = [xxhash.xxh64_intdigest(x) for x in lines], [], 0
    for k in range(len(lines)):
        window = h[max(0, k - 2) : k + 1]
        total = sum(x * 0x9E3779B97F4A7C15 ** (len(window) - 1 - j) for j, x in enumerate(window)) % (1 << 64)
        if ((total >> 32) ^ total) % 4 == 0 or k == len(lines) - 1:
            out.append((start, k + 1))
            start = k + 1
    return out


def brute_lines(texts):
    data = sorted((LAST if i is None else i, k, i, (t or "").encode().split(b"\n")) for k, (i, t, *_) in enumerate(texts))
    first, out = {}, []
    for rank, _, _, lines in data:
        for nth, (a, b) in enumerate(brute_chunks(lines)):
            if b - a >= 2:
                c = b"\n".join(lines[a:b])
                first[c] = min(first.get(c, (rank, nth)), (rank, nth))
    for rank, _, i, lines in data:
        keep, n = [], 0
        for nth, (a, b) in enumerate(brute_chunks(lines)):
            if b - a >= 2 and first[b"\n".join(lines[a:b])] != (rank, nth):
                n += 1
            else:
                keep += lines[a:b]
        out.append((i, len(lines), len(lines) - len(keep), n, hashlib.sha256(b"\n".join(keep)).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("shard_bytes", [1 << 30, 60_000])
def test_lines(docs, texts, shard_bytes):
    got = line_dedup.line_dedup(docs, shard_bytes=shard_bytes)
    assert result(got, "doc_id", "n_lines", "n_removed", "n_chunks_removed", "kept_sha256") == brute_lines(texts)


def brute_passages(texts):
    rows = sorted((LAST if i is None else i, xxhash.xxh64_intdigest((t or "").encode()), (t or "").encode().split(b"\n"), i) for i, t, *_ in texts)
    pairs = lambda lines: [(k, p) for k, p in enumerate(zip(lines, lines[1:])) if any(x.strip() for x in p)]
    first, out = {}, []
    for rank, which, lines, _ in rows:
        for k, p in pairs(lines):
            first.setdefault(p, (rank, which, k))
    for rank, which, lines, i in rows:
        gone = np.zeros(len(lines), bool)
        for k, p in pairs(lines):
            if first[p][:2] != (rank, which) or k - first[p][2] >= 2:
                gone[k : k + 2] = True
        kept = [x for x, g in zip(lines, gone) if not g]
        out.append((i, len(lines), int(gone.sum()), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return ordered(out)


def short_passages():
    """Passages of 2 to 4 lines, each within two texts that are otherwise different."""
    return [[f"passage {n} line {k}" for k in range(2 + n % 3)] for n in range(30)]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 1_000])
def test_short_passages_go(spark, docs, texts, shard_bytes):
    own = lambda i, a, b: [f"text {i} line {k}" for k in range(a, b)]
    rows = [(100 * half + n, "\n".join(own(100 * half + n, 0, 5) + p + own(100 * half + n, 5, 9))) for half in (1, 2) for n, p in enumerate(short_passages())]
    rows += [(None, "x\ny\n\n\nq"), (None, "x\ny\n\n\nz"), (900, "a\na\na\na\nb"), (901, "c\na\na\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(df, shard_bytes=shard_bytes, passages=True)
    assert result(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_passages(rows)
    removed = {r["doc_id"]: (r["n_removed"], r["n_chunks_removed"]) for r in got.collect()}
    assert all(removed[100 + n] == (0, 0) and removed[200 + n] == (len(p), 1) for n, p in enumerate(short_passages()))
    got = line_dedup.line_dedup(docs, shard_bytes=60 * shard_bytes, passages=True)
    assert result(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_passages(texts)


def test_registered_lines_remove_short_passages(spark, tmp_path):
    rows = [(100 * half + n, "\n".join([f"before {half} {n}", *p, f"after {half} {n}"])) for half in (1, 2) for n, p in enumerate(short_passages())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r["doc_id"]: r["n_removed"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert all(removed[200 + n] == len(p) for n, p in enumerate(short_passages()))


def test_line_chunks_resist_shifts():
    lines = [f"line {k * 7919 % 1000}".encode() for k in range(300)]
    a, b = line_dedup.chunks(lines), line_dedup.chunks([b"inserted", *lines])
    assert len({(i + 1, j + 1) for i, j in a} & set(b)) > 0.9 * len(a)
    assert a == brute_chunks(lines) and line_dedup.chunks([b""]) == brute_chunks([b""])
    assert [x for i, j in a for x in lines[i:j]] == lines


def test_lines_of_nothing(empty):
    assert line_dedup.line_dedup(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, ids):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_simhash(docs, texts):
    fps = [brute_fingerprint(t) for _, t, *_ in texts]
    ids = [i for i, *_ in texts]
    want = [(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, components_of(fps, ids))]
    assert result(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == ordered(want)


@pytest.mark.parametrize("run_rows", [4, 8192])
def test_simhash_links_of_near_fingerprints(spark, monkeypatch, run_rows):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)  # small: hot values are split again
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64) << np.uint64(1)
    fps = set(base.tolist())
    for f in base[rng.integers(0, 40, 300)].tolist():
        for b in rng.choice(64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.link_fingerprints(df)
    found = {(r["node"] % (1 << 64)): r["root"] % (1 << 64) for r in simhash.components(edges).collect()}
    got = {}
    for f in fps:
        got.setdefault(found.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(fps, components_of(fps, fps)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(empty):
    assert simhash.simhash_groups(empty).count() == 0


def test_gray_rank():
    x = np.array([0b0000, 0b0001, 0b0011, 0b0010, 0b0110, 0b0111, 0b0101, 0b0100], np.uint64)
    assert simhash.gray_rank(x).tolist() == list(range(8))


def edited(rng, words, share):
    """words with a share of them replaced, dropped or doubled, in runs."""
    out = list(words)
    for _ in range(max(1, int(len(words) * share / 3))):
        k = int(rng.integers(0, max(1, len(out) - 3)))
        out[k : k + 3] = [[], ["new%d" % rng.integers(1e6)], out[k : k + 3] + ["more"]][int(rng.integers(0, 3))]
    return out


def near_texts():
    rng = np.random.default_rng(11)
    fresh = lambda n: ["w%d" % k for k in rng.integers(0, 3000, n)]
    passage, texts = fresh(60), []
    for n in (3, 6, 9, 14, 25, 40, 80, 130, 260, 520, 1300, 1300):
        base = fresh(n)
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.2)] + [" ".join(base)]
    texts += [" ".join(fresh(int(rng.integers(30, 120))) + passage + fresh(20)) for _ in range(150)]  # share a passage only
    hot = fresh(150)
    texts += [" ".join(edited(rng, hot, 0.01)) for _ in range(150)]
    return texts + ["", None, " ", "one", "ONE", "one two three four five six", "x" * 100000, "y " * 40000]


def brute_near(texts):
    sets = []
    for t in texts:
        w = re.sub(r"[A-Z]", lambda m: m.group().lower(), t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return root, links
    return root, links


def test_near_groups_equal_brute_force(spark):
    texts = near_texts()
    want, links = brute_near(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    root = {r["node"]: r["root"] for r in near_dedup.near_groups(df).collect()}
    got = [root.get(k, k) for k in range(len(texts))]
    assert [(k, g, w) for k, (g, w) in enumerate(zip(got, want)) if g != w] == []
    assert len(links) > 5000


def test_first_common_shingle_is_entered():
    """Of sets at 0.8 or more, in any order: it stands in both prefixes, at places that let them be similar."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 8, 17, 33, 64, 127, 500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            names = np.sort(rng.permutation(a)[: n // 3])
            ranks = rng.permutation(len(names))
            gone, swap = int(0.2 * n + 1e-9), int(n / 9)  # one set within the other, or as many replaced on both sides
            for b in (rng.permutation(a)[gone:], np.r_[rng.permutation(a)[swap:], rng.integers(0, 1 << 63, swap).astype(np.uint64)]):
                x, y = (near_dedup.ordered(np.unique(s), names, ranks) for s in (a, b))
                common = x[np.isin(x, y)][0]
                i, j = np.flatnonzero(x == common)[0], np.flatnonzero(y == common)[0]
                assert i < near_dedup.prefix_size(len(x)) and j < near_dedup.prefix_size(len(y))
                assert near_dedup.may_be_similar(*(np.array([v]) for v in (len(x), i, len(y), j)))[0]


def test_bucket_counts_bound_what_is_shared():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 900, 90_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 63, n // 2).astype(np.uint64)])
        x, y = (np.frombuffer(near_dedup.bucket_counts(s), np.uint8) for s in (a, b))
        assert len(x) == near_dedup.BUCKETS and x.sum() <= len(a)
        assert (np.minimum(x, y) == 255).any() or np.minimum(x, y).sum(dtype=int) >= len(np.intersect1d(a, b))


def test_shingles_are_counted_as_packed_numbers(spark):
    """Keys travel packed, about four bytes each, and are counted exactly over all tasks and ranges."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5000):
        low = np.sort(np.r_[rng.integers(0, 1 << near_dedup.LOW_BITS, n), np.zeros(3)].astype(np.uint64))
        data = near_dedup.packed(low)
        assert (near_dedup.unpacked(data) == low).all() and (n < 5000 or len(data) < 4.5 * n)
    keys = rng.permutation(np.repeat(rng.integers(0, 1 << 63, 3000), rng.integers(1, 5, 3000))).astype(np.uint64)
    rows = [r for half in (keys[:4000], keys[4000:]) for b in near_dedup._ranges(iter([half]), 3) for r in b.to_pylist()]
    got = {(r["key"], r["count"]) for r in near_dedup.counted(spark.createDataFrame(rows, "range int, packed binary"), 3).collect()}
    low, n = np.unique(keys & near_dedup.LOW, return_counts=True)
    assert got == {(int(k), int(c)) for k, c in zip(low, n) if c >= 3}


def families(pairs, own, shared, boilerplate=84):
    """Pages of one template: own words, the template's, and some that only the page's partner has; partners are similar, others aren't."""
    frame = " ".join(f"frame{k}" for k in range(boilerplate))
    pages = []
    for p in range(pairs):
        ending = " ".join(f"end{p}x{k}" for k in range(shared))
        for side in "ab":
            mine = " ".join(f"own{p}{side}{k}" for k in range(own))
            pages.append(f"{mine} {frame} {ending}")
    return pages


@pytest.mark.parametrize(("own", "shared"), [(6, 9), (5, 6), (4, 4)])
def test_pages_of_a_template(spark, monkeypatch, own, shared):
    """All pairs of a template's pages are connected, whatever many others share the template."""
    texts = families(300, own, shared)
    want, links = brute_near(texts)
    # with few words of their own all pages are similar
    assert len(links) == (300 if own > 4 else 179_700)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    root = {r["node"]: r["root"] for r in near_dedup.near_groups(df).collect()}
    assert [root.get(k, k) for k in range(len(texts))] == want


def test_variants_meet_once():
    """Texts that share many shingles are paired at the first of them, whatever batches they come in; no pair is missed."""
    rng = np.random.default_rng(8)
    base = rng.permutation(300)[:60]
    texts = [np.sort(np.unique(np.r_[rng.permutation(base)[:50], rng.integers(300, 1500, 30)])) for _ in range(40)]
    texts += [np.sort(rng.permutation(np.arange(300, 1500))[:60]) for _ in range(20)]
    rows = []
    for row, keys in enumerate(texts):
        firsts = [*keys[: near_dedup.FIRSTS].tolist(), *[0] * near_dedup.FIRSTS][: near_dedup.FIRSTS]
        rows += [(int(k), 0, row, row, 1000, i, row, i, firsts, b"\xff" * near_dedup.FEWER) for i, k in enumerate(keys)]
    names = ["key", "cell", "part", "row", "n", "pos", "root", "nth", "firsts", "buckets"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in sorted(rows)])
    found = [(a, b) for out in near_dedup._across(iter(table.to_batches(max_chunksize=700))) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"))]
    shared = {(i, j): np.intersect1d(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)}
    assert set(found) == {p for p, s in shared.items() if len(s)}
    variants = [p for p in found if max(p) < 40]
    assert len(variants) < 1.5 * len(set(variants)) and sum(len(shared[p]) for p in set(variants)) > 20 * len(set(variants))


def test_near_groups_of_nothing(empty):
    assert near_dedup.near_groups(empty.selectExpr("doc_id row", "text")).count() == 0


def tasks_and_jobs(spark, run):
    """What run() returns, and the tasks and jobs that it took."""
    import uuid

    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "test")
    out = run()
    sc.setJobGroup("", "")
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    stages = [sc.statusTracker().getStageInfo(k) for j in jobs for k in j.stageIds]
    return out, sum(x.numCompletedTasks for x in stages if x), len(jobs)


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rounds_over_few_edges_take_few_tasks(spark, many_partitions):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40) if k % 10], "a long, b long")
    found, tasks, _ = tasks_and_jobs(spark, lambda: simhash.components(edges).collect())
    assert {(r["node"], r["root"]) for r in found} == {(k, 10 * ((k - 1) // 10) + 1) for k in range(2, 41) if k % 10 != 1}
    # the first writing deals the edges out; a round has no shuffle
    assert tasks < 61 * 5


def test_repeated_bits_come_in_few_jobs(spark, many_partitions):
    read = spark.createDataFrame([([k, k + 1],) for k in range(0, 3000, 3)] + [([5 << 12],), ([5 << 12],)], "keys array<long>")
    bits, _, jobs = tasks_and_jobs(spark, lambda: near_dedup.repeated_bits(read))
    assert np.flatnonzero(bits).tolist() == [(5 << 12) >> 3] and jobs < 10


def test_groups_joined_late_keep_their_members(spark, monkeypatch):
    # two groups of equal texts, and two texts of their own, are linked by what is found last only
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words, "x"]), " ".join([*words, "x"]), " ".join([*words, "y"]), "else " * 9]
    monkeypatch.setattr(near_dedup, "first_pairs", lambda entered: entered.select(F.lit(0).alias("a"), F.lit(0).alias("b")).limit(0))
    monkeypatch.setattr(near_dedup, "link_fingerprints", lambda first: first.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert result(near_dedup.near_groups(docs), "node", "root") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
