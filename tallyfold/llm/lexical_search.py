"""Ranked lexical search, a document at a time, over compressed postings of shards.

The index is a table. A shard is a run of at most SHARD_DOCS documents that one task read, put in the order of their
ids; it has a row with its documents' ids and lengths, and a row for each term with the places of the documents that
hold it and how often they do. Both are stored as gaps and counts in as few bytes each as the largest needs. Building
shuffles nothing, and a shard's size doesn't grow with the corpus, so more documents are more shards.

A search joins postings to the terms of the queries and searches each shard for each block of queries by itself. For
a query, cursors over its postings stand in a heap by document; the lowest document is scored whole, and the best of
the shard are kept in a heap of fixed size, ordered by score, then by id. Terms whose greatest possible contributions
together can't reach the worst kept score wait outside the heap and are looked up only for documents that still can;
as documents come in the order of their ids, a document that only equals the worst kept score ranks behind it, so
nothing is lost. The best of the shards are merged by one ranking, cut to `limit` rows a query in each task before
they move.

With `queries`, the index holds only terms that a sieve over the queries' terms lets through (SIEVE_BITS, 4 MB,
whatever their number): an index for one search. Without, it holds all terms and can be kept and searched again.

Scores are integers: w is floor(1000 * ln((2N + 2) / (2 df + 1))), m is 100 - B + (B * n * N) div L, and a document's
score is the sum over the query's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)).

Edge cases: null and empty texts have no term, count in neither N nor L and are never found; documents that repeat an
id are ranked each by itself, null ids behind all others; queries that repeat both id and text are one query, one id
with two texts is two, a null id is one like others; queries without a term, or none of whose terms is in a document,
have no rows; very long texts are one document like others; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SIEVE_BITS, cut, shared_folder, sieve, whole_text
from .spelling import LOWER, UPPER

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LIMIT = 20
SHARD_DOCS = 8192
#: Postings after which a shard ends before it has SHARD_DOCS documents.
SHARD_POSTINGS = 500_000
QUERIES_A_BLOCK = 256
LENGTH_SHARE = 25
SCALE, SATURATION = 1_000_000_000, 12

_TERM = re.compile(TERM_PATTERN)
_LOWERED = str.maketrans(UPPER, LOWER)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in 1, 2, 4 or 8 bytes each, after a byte that says which."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or values.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def gaps(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0)


def _sieve_bytes(rows: list) -> np.ndarray:
    """The sieve's rows (bucket, bits) as one bitmap."""
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return out


def _shard(documents: list[tuple], number: int) -> Iterator[tuple]:
    """Rows (shard, term, n_docs, n_terms, places, tfs, ids, lengths) of documents (id, length, term counts)."""
    documents.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
    places: dict[str, list[int]] = {}
    tfs: dict[str, list[int]] = {}
    for k, (_, _, counts) in enumerate(documents):
        for term, tf in counts:
            places.setdefault(term, []).append(k)
            tfs.setdefault(term, []).append(tf)
    lengths = np.array([d[1] for d in documents], np.int64)
    yield number, None, len(documents), int(lengths.sum()), None, None, [d[0] for d in documents], pack(lengths)
    for term, found in places.items():
        yield number, term, len(found), sum(tfs[term]), pack(gaps(np.array(found, np.int64))), pack(np.array(tfs[term], np.int64)), None, None


_INDEX = "shard long, term string, n_docs long, n_terms long, places binary, tfs binary, ids array<long>, lengths binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("places", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary())])


def numbered_queries(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """q, a number of its own for each query, item_id and text; written once, so the numbers stay."""
    each = queries.select(F.col(id_col).alias("item_id"), whole_text(F.col(text_col)).alias("text")).distinct()
    return cut(each.withColumn("q", F.monotonically_increasing_id()))


def query_terms(numbered: DataFrame) -> DataFrame:
    """q, term and repeats of every query."""
    term = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM_PATTERN})"), F.lit(1)))
    return numbered.select("q", term.alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("repeats"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, written to path (a new folder among the shared ones if None) and read from there.

    terms: rows (term) of the queries it is for; None indexes all terms.
    """
    spark = docs.sparkSession
    bits = None
    if terms is not None:
        # 4 MB, whatever the number of terms
        bits = spark.sparkContext.broadcast(_sieve_bytes(sieve(terms, "term").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        wanted: dict[str, bool] = {}

        def asked(term: str) -> bool:
            found = wanted.get(term)
            if found is None:
                h = xxhash.xxh64_intdigest(term.encode(), seed=42)
                slot = (h - (1 << 64) if h >> 63 else h) % SIEVE_BITS
                found = bool(bits.value[slot >> 3] >> (slot & 7) & 1)
                if len(wanted) >= 500_000:
                    wanted.clear()
                wanted[term] = found
            return found

        held: list[tuple] = []
        postings, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_shard(held, number))
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 20_000]), _INDEX_ARROW)], schema=_INDEX_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(_TERM.findall((text or "").translate(_LOWERED)))
                if counts:
                    kept = [(t, tf) for t, tf in counts.items() if bits is None or asked(t)]
                    held.append((doc_id, counts.total(), kept))
                    postings += len(kept)
                if len(held) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from flush()
                    held, postings, number = [], 0, number + 1
        if held:
            yield from flush()

    where = path or f"{shared_folder(spark)}/lexical-index-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source.mapInArrow(run, _INDEX).write.option("compression", "zstd").parquet(where)
    return spark.read.schema(_INDEX).parquet(where)


def best_of_shard(cursors: list[tuple[list[int], list[int], int]], limit: int) -> list[tuple[int, int]]:
    """(place, score) of the highest scores above 0, equal ones by place; cursors are (places, shares, weight)."""
    bounded = sorted(((weight * max(shares), places, shares, weight) for places, shares, weight in cursors), key=lambda c: c[0])
    below = [0]  # below[j]: what the first j cursors can give at most, together
    for c in bounded:
        below.append(below[-1] + c[0])
    n, least, waiting = len(bounded), 0, 0
    at = [0] * n
    standing = [(c[1][0], j) for j, c in enumerate(bounded)]
    heapq.heapify(standing)
    kept: list[tuple[int, int]] = []
    while standing:
        place, score = standing[0][0], 0
        while standing and standing[0][0] == place:
            j = standing[0][1]
            if j < waiting:
                heapq.heappop(standing)
                continue
            _, places, shares, weight = bounded[j]
            k = at[j]
            score += weight * shares[k]
            at[j] = k = k + 1
            if k < len(places):
                heapq.heapreplace(standing, (places[k], j))
            else:
                heapq.heappop(standing)
        if not score:
            continue
        for j in range(waiting - 1, -1, -1):
            if score + below[j + 1] <= least:
                break
            _, places, shares, weight = bounded[j]
            at[j] = k = bisect_left(places, place, at[j])
            if k < len(places) and places[k] == place:
                score += weight * shares[k]
        if score > least:
            if len(kept) < limit:
                heapq.heappush(kept, (score, -place))
            else:
                heapq.heapreplace(kept, (score, -place))
            if len(kept) == limit:
                least = kept[0][0]
                while waiting < n and below[waiting + 1] <= least:
                    waiting += 1
    return [(-place, score) for score, place in kept]


def _search_shard(limit: int, n_docs: int, n_terms: int):
    def run(table: pa.Table) -> pa.Table:
        head = next(r for r in table.filter(pa.compute.is_null(table["term"])).to_pylist())
        ids, m = head["ids"], 100 - LENGTH_SHARE + (LENGTH_SHARE * unpack(head["lengths"]) * n_docs) // n_terms
        of: dict[int, list] = {}
        for r in table.filter(pa.compute.is_valid(table["term"])).select(["places", "tfs", "asked"]).to_pylist():
            places, tfs = np.cumsum(unpack(r["places"])), unpack(r["tfs"])
            shares = ((SCALE * tfs) // (1000 * tfs + SATURATION * m[places])).tolist()
            places = places.tolist()
            for a in r["asked"]:
                of.setdefault(a["q"], []).append((places, shares, a["weight"]))
        rows = [(q, ids[place], score) for q, cursors in of.items() for place, score in best_of_shard(cursors, limit)]
        return pa.table({"q": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def search(index: DataFrame, numbered: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id and score of the highest-scoring documents of each query of numbered."""
    heads = index.filter("term IS NULL")
    totals = heads.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 1
    terms = cut(query_terms(numbered))
    blocks = max(1, -(-numbered.count() // QUERIES_A_BLOCK))
    postings = index.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
    ratio = (2 * F.lit(n_docs).cast("double") + 2) / (2 * F.sum("n_docs") + 1)
    weights = postings.groupBy("term").agg(F.floor(1000 * F.log(ratio)).alias("w")).filter("w > 0")
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")
    asked = (
        terms.join(weights, "term")
        .groupBy("term", block)
        .agg(F.collect_list(F.struct("q", (F.col("w") * F.col("repeats")).alias("weight"))).alias("asked"))
    )
    nothing = F.lit(None)
    wanted = postings.join(asked, "term").select("shard", "block", "term", "places", "tfs", nothing.cast("array<long>").alias("ids"), nothing.cast("binary").alias("lengths"), "asked")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    shards = heads.select("shard", each.alias("block"), "term", "places", "tfs", "ids", "lengths", nothing.cast("array<struct<q:bigint,weight:bigint>>").alias("asked"))
    best = shards.unionByName(wanted).groupBy("shard", "block").applyInArrow(_search_shard(limit, n_docs, n_terms), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of docs (doc_id, text) for each of queries (item_id, text)."""
    numbered = numbered_queries(queries)
    index = build_index(docs, query_terms(numbered).select("term").distinct())
    return search(index, numbered, limit)
