"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of the last WINDOW lines; where it is 0 modulo SPREAD a chunk ends, so an inserted line
moves the boundaries near it only. A chunk of two lines or more that stands in several places is kept in the first, by
id and place, and removed in the others, once its bytes have been compared.

With passages=True every line ends a chunk and each is grown by its next lines for as long as they are found together
elsewhere: any MIN_LINES consecutive lines that stand in an earlier place are removed, so a repeated passage goes in
full, whatever stands around it. Two blank lines are no passage of their own. Within a document a passage isn't
removed where it overlaps its first place. Of each line at least the first place in the table stays.

Documents are dealt into shards by row, so copies of one row are spread too. A shard names the hashes of its chunks,
hears which are found elsewhere as well, sends the bytes of those only, each once, and hears where they are found
first: a minimum over the bytes, summed up before it is shuffled. A chunk that a third of all documents hold is one
row for each shard, which a skewed join splits.

Edge cases: null texts count as empty; a chunk found twice in one document stays once; rows that repeat an id follow
each other in the order of their texts and, by chunks, lose the same ones; by passages, they are documents of their
own, but rows that repeat an id and its text lose the same lines; null ids come last and count as one id; a text of
one line has no multi-line chunk; ids are whole numbers; other columns are ignored; an empty table gives an empty result. The rows must come in the same
order whenever the table is read, as from files; write a table first whose order may change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WINDOW = 3
SPREAD = 4
MIN_LINES = 2
SHARD_BYTES = 8_000_000
LAST_ID = (1 << 63) - 1
PLACE = ("id", "which", "nth")
_M = (1 << 64) - 1


def chunks(lines: list[bytes], window: int = WINDOW, spread: int = SPREAD) -> list[tuple[int, int]]:
    """(first line, end) of each chunk; together they are all lines."""
    import xxhash

    h = [xxhash.xxh64_intdigest(x) for x in lines]
    out, start = [], 0
    for k in range(len(lines)):
        roll = 0
        for x in h[max(0, k - window + 1) : k + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + x) & _M
        if (roll ^ roll >> 32) % spread == 0:
            out.append((start, k + 1))
            start = k + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


class _Shard:
    """Rows in order of their ids and texts; a place is (id, which text of the id, nth chunk of the text)."""

    def __init__(self, table: pa.Table, passages: bool):
        import xxhash

        self.passages = passages
        ids = [LAST_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        which = [xxhash.xxh64_intdigest(t) - (1 << 63) if passages else 0 for t in texts]
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], which[k], texts[k]))
        self.ids = [ids[k] for k in self.order]
        self.which = [which[k] for k in self.order]
        self.lines = [texts[k].split(b"\n") for k in self.order]

    def hashes(self) -> Iterator[tuple[int, list[int], list[tuple[int, int, int]]]]:
        """Of each row its number, the hashes of its multi-line chunks and their (nth, first line, end)."""
        import xxhash

        for row, lines in enumerate(self.lines):
            if self.passages:
                h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
                made = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).view(np.int64)
                places = [(k, k, k + MIN_LINES) for k in range(len(made))]
                if b"" in lines:
                    keep = [k for k in range(len(made)) if lines[k].strip() or lines[k + 1].strip()]
                    made, places = made[keep], [places[k] for k in keep]
                yield row, made.tolist(), places
            else:
                places = [(nth, i, j) for nth, (i, j) in enumerate(chunks(lines)) if j - i >= MIN_LINES]
                yield row, [xxhash.xxh64_intdigest(b"\n".join(lines[i:j]), seed=7) - (1 << 63) for _, i, j in places], places

    def named(self, names: set[int]) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """(row, nth, first line, end, hash, bytes) of each chunk whose hash is in names, in order."""
        for row, made, places in self.hashes():
            for h, (nth, i, j) in zip(made, places):
                if h in names:
                    yield row, nth, i, j, h, b"\n".join(self.lines[row][i:j])


def _name(passages: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.array(made, np.int64) for _, made, _ in _Shard(table, passages).hashes()]
        h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        return pa.table({"h": pa.array(h), "shard": pa.array(np.full(len(h), key[0].as_py(), np.int32)), "n": pa.array(n.astype(np.int64))})

    return run


def _send(passages: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, wanted: pa.Table) -> pa.Table:
        rows: dict[bytes, tuple] = {}
        if docs.num_rows and wanted.num_rows:
            shard = _Shard(docs, passages)
            for row, nth, _, _, h, data in shard.named(set(wanted.column("h").to_pylist())):
                if data not in rows:
                    rows[data] = (h, len(rows), shard.ids[row], shard.which[row], nth)
        columns = list(zip(*rows.values())) or [()] * 5
        made = {n: pa.array(c, pa.int64()) for n, c in zip(("h", "number", "id", "which", "nth"), columns)}
        return pa.table(made | {"shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "data": pa.array(list(rows), pa.binary())})

    return run


def _cut(with_text: bool, passages: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, wanted: pa.Table) -> pa.Table:
        shard = _Shard(docs, passages)
        first = {n: tuple(p) for n, *p in zip(*(wanted.column(c).to_pylist() for c in ("number", *PLACE)))} if wanted.num_rows else {}
        names = set(wanted.column("h").to_pylist()) if wanted.num_rows else set()
        number: dict[bytes, int] = {}
        gone: list[set[int]] = [set() for _ in shard.lines]
        dropped = [0] * len(shard.lines)
        for row, nth, i, j, _, data in shard.named(names):
            n = number.setdefault(data, len(number))
            *text, at = first[n]
            own = text == [shard.ids[row], shard.which[row]]
            if not own or (nth - at >= MIN_LINES if passages else nth != at):
                # a passage that goes on from a removed line is the same one
                dropped[row] += not (passages and i in gone[row])
                gone[row].update(range(i, j))
        kept = [b"\n".join([x for k, x in enumerate(lines) if k not in g]) for lines, g in zip(shard.lines, gone)]
        return pa.table({
            "doc_id": docs.column("doc_id").cast(pa.int64()).take(pa.array(shard.order)),
            "n_lines": pa.array([len(x) for x in shard.lines], pa.int64()),
            "n_removed": pa.array([len(g) for g in gone], pa.int64()),
            "n_chunks_removed": pa.array(dropped, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept": pa.array([k.decode("utf-8", "replace") for k in kept] if with_text else [None] * len(kept), pa.string()),
        })

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, shard_bytes: int = SHARD_BYTES, passages: bool = False) -> DataFrame:
    """doc_id (as long), n_lines, n_removed, n_chunks_removed, kept_sha256 and, if asked for, kept of every row of docs.

    passages removes every repeated passage of MIN_LINES lines or more, not only whole chunks; n_chunks_removed then
    counts passages.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    n_shards = max(1, -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    shards = source.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")).groupBy("shard")
    named = shards.applyInArrow(_name(passages), "h long, shard int, n long")
    repeated = named.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1").select("h")
    wanted = named.join(repeated, "h").select("shard", "h")
    sent = shards.cogroup(wanted.groupBy("shard")).applyInArrow(_send(passages), "h long, number long, id long, which long, nth long, shard int, data binary")
    # the bytes are the key, so equal hashes of different chunks stay apart; one that all shards send is summed where it is sent
    first = sent.groupBy("h", "data").agg(F.min(F.struct(*PLACE)).alias("first"))
    firsts = sent.select("h", "data", "shard", "number").join(first, ["h", "data"]).select("shard", "number", "first.*")
    # the names and the answers of a shard come back together
    both = firsts.unionByName(wanted, allowMissingColumns=True).select("shard", "number", *PLACE, "h")
    return shards.cogroup(both.groupBy("shard")).applyInArrow(_cut(with_text, passages), "doc_id long, n_lines long, n_removed long, n_chunks_removed long, kept_sha256 string, kept string")
