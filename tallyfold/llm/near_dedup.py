"""Near-dedup at a Jaccard similarity of 0.8 or more on sets of five-word shingles: SimHash first, then an exact rest.

The Gray index (simhash.py) links texts whose 64-bit fingerprints differ in 3 bits at most, which finds what differs
little. At 0.8 fingerprints differ in some 10 bits, for which blocks of 64 bits are too short, so the rest meets by
shingles: all texts put theirs in one order, and two similar ones have their first common shingle among the first
n - ceil(0.8 n) + 1 of each. A text is entered under these only. Any order does; this one puts shingles last that a
bounded sample of texts (SAMPLE_TEXTS) has more than once, the most frequent (FREQUENT of them at most) at the end, so
that what pages of one template share stands in no entry. Entries that no other text has are dropped by a sieve before
they move. What meets must fit in length, in how much can follow the common shingle and in counts over buckets, and is then checked
on the whole sets. No similar pair is missed, no link comes from bits alone, and no cap drops a candidate.

Texts under one shingle don't all meet at once. First each meets the first of them and its neighbours in a shuffled
order, within a batch before the shuffle and then among what batches sent; links found so make groups. Then only texts
of different groups meet, for shingles that have several groups: large ones in blocks of BLOCK_ROWS, the largest group's
members with the others only. Variants of one text share many shingles; each entry brings the first FIRSTS of its text,
and two texts that have an earlier one of these in common are left to the meeting there.

Edge cases: texts without words (null, empty) are equal to each other and like no other; texts of fewer than five
words are one shingle; repeated rows share a component; an empty table gives an empty result. The key must be a
unique number from 0 on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, cut, sieve, sifted
from .components import components
from .simhash import link_fingerprints, majority, shingle_hashes

WORDS_EACH = 5
SIMILARITY = 0.8
#: Texts that the order of shingles is taken from, and frequent shingles it holds at most.
SAMPLE_TEXTS, FREQUENT, OFTEN = 20_000, 1 << 17, 3
#: Low bits of a shingle's hash that stand for it where shingles are only counted; a wrong meeting there costs work, no link.
LOW_BITS = 40
LOW = np.uint64((1 << LOW_BITS) - 1)
#: Numbers that a task packs at once, and those of a range that is counted at once, about.
PACKED, RANGE = 1 << 21, 1 << 18
#: Ranges of the sample's shingles, 2 to this.
SAMPLE_RANGES = 6
#: Neighbours in the shuffled order of a shingle's texts that a text meets at first.
NEIGHBOURS = 2
#: Rows of a shingle that a batch sends as they are; of more it sends the first in both orders.
SENT_WHOLE = 8
#: Buckets over which a set's shingles are counted for the last test before the check.
BUCKETS = 256
#: Buckets where texts of different groups meet, each several of those.
FEWER = 64
#: First shingles of a text, of those that different groups have, that say whether two texts met before.
FIRSTS = 4
#: Texts whose sets a task holds at once.
SLICE_TEXTS = 250
#: Texts of a block, where more have a shingle.
BLOCK_ROWS = 4096


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles."""
    return np.unique(shingle_hashes(text, WORDS_EACH))


def prefix_size(n: int) -> int:
    """How many of n shingles two similar sets must have their first common one among."""
    return n - -(-4 * n // 5) + 1 if n else 0


def may_be_similar(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of na and nb shingles, whose first common one is at places pa_ and pb of the order, can be similar."""
    most = np.minimum(na - pa_, nb - pb)
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * most >= 4 * (na + nb))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds the sets of few texts at once."""
    for batch in batches:
        yield from (batch.slice(k, SLICE_TEXTS) for k in range(0, batch.num_rows, SLICE_TEXTS))


# ---- counting shingles ----
def packed(low: np.ndarray) -> bytes:
    """Sorted numbers of LOW_BITS bits, repeats included, as gaps with their bytes of one place together, compressed."""
    gaps = np.diff(low, prepend=np.uint64(0))
    return zlib.compress(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data), np.uint8).reshape(LOW_BITS // 8, -1)
    gaps = np.zeros((places.shape[1], 8), np.uint8)
    gaps[:, : LOW_BITS // 8] = places.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _ranges(keys: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, packed): the low bits of the keys, dealt over 2^bits ranges."""

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        low = np.sort(np.concatenate(parts) & LOW)
        of = low >> np.uint64(LOW_BITS - bits)
        cuts = np.r_[np.flatnonzero(_first(of)), len(low)]
        data = [packed(low[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["range", "packed"])

    parts, held = [], 0
    for k in keys:
        parts.append(k)
        held += len(k)
        if held >= PACKED:
            yield rows(parts)
            parts, held = [], 0
    if held:
        yield rows(parts)


def counted(ranges: DataFrame, least: int) -> DataFrame:
    """key and count of the low bits in rows (range, packed) that occur least times or more."""

    def run(table: pa.Table) -> pa.Table:
        low, n = np.unique(np.concatenate([unpacked(x.as_py()) for x in table.column("packed")]), return_counts=True)
        often = n >= least
        return pa.table({"key": low[often].view(np.int64), "count": n[often].astype(np.int64)})

    return ranges.groupBy("range").applyInArrow(run, "key long, count long")


# ---- the entries of each text ----
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _ranges((shingle_set(t.as_py()) for batch in batches for t in batch.column(0)), SAMPLE_RANGES)


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Low bits of shingles that several texts of the sample have, those of most texts last; FREQUENT at most."""
    every = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(_sample, "range int, packed binary")
    often = counted(sample, OFTEN).orderBy(F.desc("count"), "key").limit(FREQUENT)
    # as one column, not as a row object each in the driver
    return often.select("key").toArrow().column("key").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def ordered(shingles: np.ndarray, names: np.ndarray, ranks: np.ndarray, bits: np.uint64 = ~np.uint64(0)) -> np.ndarray:
    """The set in the order of all texts: by rank among the frequent ones (names, sorted, with their ranks), then by hash.

    bits: those of a shingle that its name has.
    """
    if not len(names):
        return shingles
    short = shingles & bits
    at = np.minimum(np.searchsorted(names, short), len(names) - 1)
    rank = np.where(names[at] == short, ranks[at] + 1, 0)
    return shingles[np.lexsort((shingles, rank))]


_ENTRIES = "row long, n int, fp long, whole binary, buckets binary, keys array<long>"


def entries(texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """row, n, fp, whole (a digest of the set), buckets (bucket_counts) and keys, the first shingles of the order, of every row of texts(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.argsort(frequent.value)
        names = frequent.value[ranks]
        for batch in _sliced(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            fps = np.array([majority(s) for s in sets], np.uint64)
            whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys = [ordered(s, names, ranks, LOW)[: prefix_size(len(s))].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps.view(np.int64)), pa.array(whole, pa.binary()), pa.array(map(bucket_counts, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "n", "fp", "whole", "buckets", "keys"])

    return texts.mapInArrow(run, _ENTRIES)


def repeated_bits(read: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE_BITS bits (4 MB) over the low bits of the keys that several entries have; they are hashes already."""
    every = read.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(max(every // RANGE, 1).bit_length(), LOW_BITS // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ranges((batch.column(0).flatten().to_numpy().view(np.uint64) for batch in batches), bits)

    ranges = read.select("keys").mapInArrow(run, "range int, packed binary")
    several = counted(ranges, 2).select((F.col("key").bitwiseAND(F.lit(SIEVE_BITS - 1)) + 1).alias("slot"))
    rows = several.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    # in one job, 4 MB: fetched by partitions it is a job for each
    found = rows.toArrow()
    for bucket, data in zip(found.column("bucket").to_pylist(), found.column("bits")):
        bits = np.frombuffer(data.as_py(), np.uint8)
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return out


def met_entries(read: DataFrame, repeated: Broadcast) -> DataFrame:
    """key, row, n and pos of the entries whose key another may have: what only one text has meets nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = repeated.value
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            key, of = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), size)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            slot = key & (SIEVE_BITS - 1)
            met = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            row, n = (batch.column(c).to_numpy()[of[met]] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(row), pa.array(n, pa.int32()), pa.array(pos[met], pa.int32())], ["key", "row", "n", "pos"])

    return read.select("row", "n", "keys").mapInArrow(run, "key long, row long, n int, pos int")


def can_share(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of n shingles together can be similar by their bucket counts: in a bucket no more is shared than the
    smaller count; 255 stands for any number."""
    least = np.minimum(x, y)
    return (9 * least.sum(axis=1, dtype=np.int64) >= 4 * n) | (least == 255).any(axis=1)


# ---- first meetings ----
SENT = "key long, row long, n int, pos int, mate long"


def _table(key: np.ndarray, row: np.ndarray, n: np.ndarray, pos: np.ndarray, mate: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(key), pa.array(row), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(mate)]
    return pa.RecordBatch.from_arrays(columns, ["key", "row", "n", "pos", "mate"])


def _first(key: np.ndarray) -> np.ndarray:
    return np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)


def _meet(key: np.ndarray, row: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
    """Of rows sorted by key and row: places of those that stand for their key elsewhere, and the pairs that may be similar."""
    lead = _first(key)
    first = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
    order = np.lexsort((_mixed(_mixed(row.view(np.uint64)) ^ key.view(np.uint64)), key))
    shuffled, at, to = key[order], [np.flatnonzero(~lead)], [first[~lead]]
    for step in range(1, NEIGHBOURS + 1):
        same = np.flatnonzero(shuffled[step:] == shuffled[:-step])
        at.append(order[same + step])
        to.append(order[same])
    a, b = np.concatenate(at), np.concatenate(to)
    fine = (row[a] != row[b]) & may_be_similar(n[a], pos[a], n[b], pos[b])
    pairs = np.unique(np.stack([np.maximum(row[a], row[b])[fine], np.minimum(row[a], row[b])[fine]], axis=1), axis=0)
    nothing = np.zeros(len(pairs), np.int64)
    # any key will do for a pair: it spreads them over the tasks
    found = _table(_mixed(pairs[:, 0].view(np.uint64)).view(np.int64) if len(pairs) else nothing, pairs[:, 0], nothing, nothing, pairs[:, 1])
    place = np.flatnonzero(lead)
    size = np.diff(np.r_[place, len(key)])
    few = np.repeat(size <= SENT_WHOLE, size)
    return np.unique(np.r_[place, order[_first(shuffled)], np.flatnonzero(few)]), found


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of each key in a batch of entries, and the pairs in it."""
    for batch in batches:
        if batch.num_rows:
            key, row, n, pos = _columns(batch, ("key", "row", "n", "pos"))
            order = np.lexsort((row, key))
            key, row, n, pos = (x[order] for x in (key, row, n, pos))
            sent, pairs = _meet(key, row, n, pos)
            yield _table(key[sent], row[sent], n[sent], pos[sent], np.full(len(sent), -1, np.int64))
            yield pairs


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) among rows sorted by key and row; pairs found before pass through."""
    last = [np.zeros(0, np.int64) for _ in range(4)]
    for batch in batches:
        *columns, mate = _columns(batch, ("key", "row", "n", "pos", "mate"))
        done = mate >= 0
        yield pa.RecordBatch.from_arrays([pa.array(columns[1][done]), pa.array(mate[done])], ["a", "b"])
        key, row, n, pos = (np.r_[x, y[~done]] for x, y in zip(last, columns))
        pairs = _meet(key, row, n, pos)[1]
        yield pa.RecordBatch.from_arrays([pairs.column("row"), pairs.column("mate")], ["a", "b"])
        # the first row of the last key meets those of the next batch
        last = [x[np.flatnonzero(_first(key))[-1:]] for x in (key, row, n, pos)]


def first_pairs(entered: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of entries (key, row, n, pos): each text with the first of its key, and with neighbours."""
    dealt = entered.mapInArrow(_send, SENT).repartition("key").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(_pair, "a long, b long").distinct()


# ---- meetings of different groups ----
def met_before(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether two texts have a shingle in common before the one that is place nx and ny of theirs; x, y: their first FIRSTS.

    All texts have one order, so what they share earlier brought them together there.
    """
    met = np.zeros(len(nx), bool)
    for i in range(FIRSTS):
        for j in range(FIRSTS):
            met |= (x[:, i] == y[:, j]) & (i < nx) & (j < ny)
    return met


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may be similar among rows (key, cell, part, row, n, pos, root, nth, firsts, buckets) sorted by key and cell.

    Only rows of different parts and roots meet; in the cell of a block with itself part is the row's own.
    """
    names = ("key", "cell", "part", "row", "n", "pos", "root", "nth")
    left = [*(np.zeros(0, np.int64) for _ in names), np.zeros((0, FIRSTS), np.int64), np.zeros((0, FEWER), np.uint8)]

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cell, part, row, n, pos, root, nth, firsts, counts = columns
        new = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])] if len(key) else np.zeros(0, bool)
        group = np.cumsum(new)
        size = np.bincount(group, minlength=1)[group] if len(key) else group
        at, step = np.flatnonzero(size > 1), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[group[at + step] == group[at]]
            to = at + step
            fine = (root[at] != root[to]) & (part[at] != part[to]) & may_be_similar(n[at], pos[at], n[to], pos[to])
            x, y = at[fine], to[fine]
            new_here = ~met_before(firsts[x], nth[x], firsts[y], nth[y])
            x, y = x[new_here], y[new_here]
            enough = can_share(counts[x], counts[y], n[x] + n[y])
            a, b = row[x[enough]], row[y[enough]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
            step += 1

    for batch in batches:
        counts = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), np.uint8).reshape(-1, FEWER)
        firsts = batch.column("firsts").flatten().to_numpy().reshape(-1, FIRSTS)
        columns = [np.concatenate([x, y]) for x, y in zip(left, [*_columns(batch, names), firsts, counts])]
        # the last cell goes on in the next batch
        key, cell = columns[0], columns[1]
        whole = (key != key[-1]) | (cell != cell[-1]) if len(key) else np.zeros(0, bool)
        yield from pairs([x[whole] for x in columns])
        left = [x[~whole] for x in columns]
    yield from pairs(left)


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and its bucket counts, several buckets taken together."""
    for batch in batches:
        counts = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), np.uint8).reshape(-1, FEWER, BUCKETS // FEWER)
        # what stands for 255 or more makes the sum stand for it too
        together = np.minimum(counts.sum(axis=2, dtype=np.int64), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c.tobytes() for c in together], pa.binary())], ["row", "buckets"])


def further_pairs(entered: DataFrame, roots: DataFrame, read: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of entries (key, row, n, pos) of different groups that may be similar; roots: node, root.

    read: row and buckets, by which a pair is tested where it meets.
    """
    named = cut(entered.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")))
    sized = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("many"), F.sum("size").alias("all"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK_ROWS), F.lit(1)).cast("int")
    contested = cut(sized.filter("all > many").select("key", "main", blocks(F.col("many")).alias("d"), blocks(F.col("all") - F.col("many")).alias("o")))
    met = named.join(contested, "key").withColumn("is_main", F.col("root") == F.col("main"))
    texts = met.groupBy("row", "n", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "is_main", "d", "o"))).alias("found"))
    firsts = F.array(*(F.coalesce(F.get("found.key", F.lit(k)), F.lit(0).cast("long")) for k in range(FIRSTS)))
    buckets = read.select("row", "buckets").mapInArrow(_fewer, "row long, buckets binary")
    met = texts.join(buckets, "row").select("row", "n", "root", "buckets", firsts.alias("firsts"), F.posexplode("found").alias("nth", "e"))
    own = F.pmod(F.xxhash64("row"), F.when(F.col("is_main"), F.col("d")).otherwise(F.col("o"))).cast("int")
    met = met.select("*", "e.*").withColumn("own", own)
    # cells of the largest group's blocks with others', then of others' with each other: number, and the side that a row is on
    cell = lambda i, j: i.cast("long") * F.col("o") + j
    beyond = F.col("d").cast("long") * F.col("o")
    sides = F.sequence(F.lit(0), F.col("o") - 1)
    of_main = F.transform(sides, lambda j: F.struct(cell(F.col("own"), j).alias("cell"), F.lit(-1).cast("long").alias("part")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.struct(cell(i, F.col("own")).alias("cell"), F.lit(-2).cast("long").alias("part")))
    among = F.transform(
        sides,
        lambda j: F.struct((beyond + cell(F.least(j, F.col("own")), F.greatest(j, F.col("own")))).alias("cell"), F.when(j == F.col("own"), F.col("row")).otherwise(-3 - F.col("own").cast("long")).alias("part")),
    )
    spread = met.withColumn("c", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(to_main, among))))
    dealt = spread.select("key", "c.cell", "c.part", "row", "n", "pos", "root", "nth", "firsts", "buckets").repartition("key", "cell").sortWithinPartitions("key", "cell", "row")
    return dealt.mapInArrow(_across, "a long, b long").distinct()


# ---- the check ----
def bucket_counts(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of BUCKETS; 255 stands for that many or more."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)) & np.uint64(BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array(can_share(x, y, n)))


def plausible(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets can have enough in common: no more in a bucket than the smaller of its two counts."""
    side = lambda row, n, name: read.select(F.col("row").alias(row), F.col("n").alias(n), F.col("buckets").alias(name))
    return pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_plausible, "a long, b long")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        sets: dict[int, np.ndarray] = {}
        keep = []
        for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y"))):
            for row, text in ((a.as_py(), x), (b.as_py(), y)):
                if row not in sets:
                    sets[row] = shingle_set(text.as_py())
            p, q = sets[a.as_py()], sets[b.as_py()]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            # shared / union in whole numbers, so that exactly 0.8 counts; two empty sets are equal
            keep.append(shared * 1000 >= round(SIMILARITY * 1000) * (len(p) + len(q) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of texts(row, text) whose shingle sets have a similarity of SIMILARITY or more.

    Texts travel, not their sets, which are several times as large after compression.
    """
    wanted = sieve(pairs.select(F.explode(F.array("a", "b")).alias("row")), "row")
    # a wrong hit of the sieve only brings a text that no pair asks for
    asked = sifted(texts, wanted, ("row",), "asked").filter("asked").select("row", "text")
    side = lambda row, name: asked.select(F.col("row").alias(row), F.col("text").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_check, "a long, b long")


def near_groups(docs: DataFrame, key_col: str = "row", text_col: str = "text") -> DataFrame:
    """(node, root) of every key that is linked to another; root, the smallest key of its group, has a row as well."""
    texts = docs.select(F.col(key_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts))
    read = cut(entries(texts, frequent))
    # equal sets are linked by their digests, what is near in bits goes to the check
    alike = cut(read.groupBy("whole").agg(F.min("row").alias("b")))
    same = read.select("whole", F.col("row").alias("a")).join(alike, "whole").filter("a <> b").select("a", "b")
    first = cut(read.groupBy("fp").agg(F.min("row").alias("first")))
    named = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    gray = link_fingerprints(first.select("fp")).distinct().withColumnsRenamed({"a": "u", "b": "v"})
    near = gray.join(named("u", "a"), "u").join(named("v", "b"), "v").select("a", "b")
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_bits(read))
    entered = cut(met_entries(read, repeated))
    pairs = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(first_pairs(entered)).distinct()
    links = cut(same.unionByName(similar(texts, cut(plausible(pairs, read)))))
    # the first links make groups; those found later only join groups, by their roots
    roots = cut(components(links))
    further = similar(texts, cut(plausible(further_pairs(entered, roots, read), read)))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = further.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a group's members take the root of what their group joined, its old root and what joined by itself likewise
    moved = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    every = cut(moved.unionByName(joined.select(F.col("root").alias("node"), F.col("top").alias("root"))))
    return cut(every.unionByName(every.select(F.col("root").alias("node"), "root").distinct()))
