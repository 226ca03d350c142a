"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints are joined first, so an index holds each once. Two of at most 3 differing bits agree on one of
four 16-bit blocks, so fingerprints meet by (block, value); a value with more than RUN_ROWS of them is split again by
four 12-bit blocks of the other bits, on one of which a linked pair agrees as well, so no link is lost. Within a task
the fingerprints of a key are sorted by Gray rank and grouped into a tree whose nodes hold the bits that all below
share; a query adds up its differences from node to node and leaves a subtree once there are more than 3. A task
links each fingerprint to the smallest of its local group only, never to all partners; groups are then merged over
the cluster.

Edge cases: null and empty texts have fingerprint 0, linked like any other; texts of one or two words are one shingle;
equal texts and repeated rows share a component; null ids don't name a component unless it has no other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DIFF = 3
RUN_ROWS = 8192
GROUP_ROWS = 16384
FANOUT = 16
#: Query-node pairs compared at once in a task.
FRONTIER = 1_000_000


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words are one shingle, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(words_each)))) if len(words) >= words_each else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, max(1, len(words) - words_each + 1))


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: bit set if set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprint(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    return majority(shingle_hashes(text, words_each, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row of docs."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), words_each) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints sorted by run and Gray rank; each node holds what all below it share."""

    def __init__(self, run: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), run))
        self.order, self.fps, self.run = order, fps[order], run[order]
        ones, zeros, runs = self.fps, ~self.fps, self.run
        self.levels: list[dict[str, np.ndarray]] = []
        while True:
            first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            size = np.diff(np.r_[first, len(runs)])
            within = np.arange(len(runs)) - np.repeat(first, size)
            start = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            self.levels.append({"start": start, "end": np.r_[start[1:], len(runs)], "mask": ones | zeros, "bits": ones})
            runs = runs[start]
            if np.bincount(np.unique(runs, return_inverse=True)[1]).max() <= FANOUT:
                break
        self.top_runs, self.top_first, self.top_size = np.unique(runs, return_index=True, return_counts=True)

    @staticmethod
    def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """start, start + 1, ... of each, size of them."""
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)

    def search(self, lo: int, hi: int, most: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a query in lo..hi, a later place of the same run) with at most so many differing bits."""
        at = np.searchsorted(self.top_runs, self.run[lo:hi])
        q = np.repeat(np.arange(lo, hi), self.top_size[at])
        node = self._spread(self.top_first[at], self.top_size[at])
        level = self.levels[-1]
        diff = np.bitwise_count((self.fps[q] ^ level["bits"][node]) & level["mask"][node]).astype(np.int8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = diff <= most
            q, node, diff = q[keep], node[keep], diff[keep]
            size = level["end"][node] - level["start"][node]
            below = self._spread(level["start"][node], size)
            q, diff, seen = np.repeat(q, size), np.repeat(diff, size), np.repeat(level["mask"][node], size)
            if depth:
                lower = self.levels[depth - 1]
                diff = diff + np.bitwise_count((self.fps[q] ^ lower["bits"][below]) & lower["mask"][below] & ~seen).astype(np.int8)
            else:
                later = below > q
                q, below = q[later], below[later]
                diff = diff[later] + np.bitwise_count((self.fps[q] ^ self.fps[below]) & ~seen[later]).astype(np.int8)
            node = below
        keep = diff <= most
        return q[keep], node[keep]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the smaller label to all that a pair connects, in place."""
    while True:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))


def local_links(run: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, the one that stands for its group) of the linked ones within runs."""
    index = GrayIndex(run, fps)
    n, label = len(fps), np.arange(len(fps))
    width = np.repeat(*np.unique(index.run, return_counts=True)[1:2] * 2) if n else np.zeros(0, int)
    bounds = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + FRONTIER, FRONTIER)) if n else []
    edges = np.unique(np.r_[0, bounds, n])
    for lo, hi in zip(edges[:-1], edges[1:]):
        a, b = index.search(int(lo), int(hi))
        merge_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return index.fps[linked], index.fps[label[linked]]


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    run = pdf["run"].to_numpy()
    _, inverse, count = np.unique(run, return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    if not several.any():
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = local_links(run[several], pdf["fp"].to_numpy().view(np.uint64)[several])
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of distinct(fp) that connect all linked ones."""
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(4))))
    keyed = distinct.select("fp", blocks.alias("k")).select("fp", "k.*")
    hot = cut(keyed.groupBy("i", "value").count().filter(F.col("count") > RUN_ROWS).select("i", "value", F.lit(True).alias("hot")))
    # the other 48 bits, in order: those above block i and those below it
    below = F.expr("fp & (shiftleft(1L, 16 * i) - 1)")
    others = F.expr("CASE WHEN i = 3 THEN 0L ELSE shiftleft(shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) END").bitwiseOR(below)
    parts = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(others, 12 * j).bitwiseAND(F.lit(0xFFF)).alias("part")) for j in range(4)))
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("part")))
    met = keyed.join(hot, ["i", "value"], "left").withColumn("s", F.explode(F.when(F.col("hot"), parts).otherwise(whole)))
    met = met.select("fp", F.expr("((i * 65536L + value) * 5 + s.j + 1) * 4096L + s.part").alias("run"))
    n_groups = max(64, 4 * distinct.count() // GROUP_ROWS)
    return met.groupBy(F.pmod(F.xxhash64("run"), F.lit(n_groups)).alias("g")).applyInPandas(_linked, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row of docs."""
    rows = cut(fingerprints(docs, id_col, text_col))
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link_fingerprints(first.select("fp")))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    named = member.join(first, "fp")
    lowest = named.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = named.join(lowest, "root").select("fp", "lowest")
    of_fp = cut(first.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")))
    return rows.join(of_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
