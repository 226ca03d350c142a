"""Dedup of long repeated byte strings by sorting suffixes, deep-shallow style.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Sorting every
suffix of a corpus would ship each many times over, so suffixes first meet by anchors: each string of LENGTH bytes has
one anchor, the least hash of GRAM bytes in it; equal strings have equal anchors, so strings are compared with those of
their own anchor only and none is missed.

1. Documents are dealt into shards by row, so copies of one row are spread too. A shard sends the names of its anchors
   (NAME_BITS of their hash) with the number of their contexts.
2. Anchors that only one document has end here; each shard hears which of its own are shared, and which are hot, with
   over HOT_CONTEXTS contexts in all.
3. A shard sends the strings around its shared anchors, overlapping ones as one context, equal contexts once with the
   smallest and largest id. Strings of hot anchors travel one by one under a name of their own, so a hot anchor is
   spread over all tasks; each distinct string of a shard goes once.
4. The suffixes that start in contexts of one anchor are sorted: multikey quicksort to a shallow depth, then blind
   tries for groups with longer common prefixes. Those whose first LENGTH bytes are equal get the smallest id.
5. Each shard hears the smallest ids of its contexts, and cuts its texts.

Hashes only bring together what may be equal: contexts or strings are taken for equal after their bytes are compared,
in a shard as over shards, and those that merely share hashes stay apart.

What a shard sends is packed by ranges of hashes, FAN ranges at most. Where more are needed, a further hop regroups
the packets of FAN shards and one range into FAN finer ranges. So a hop makes at most FAN packets for each shard and
the rows shuffled grow in proportion to the input: one hop to FAN * SHARD_BYTES of text (34 GB), two to FAN times that.

Edge cases: null texts count as empty; texts under LENGTH bytes stay whole; rows that repeat an id aren't smaller than
each other; ids are whole numbers; null ids count as larger than any other; other columns are ignored; an empty table
gives an empty result. The rows must come in the same order whenever the table is read, as from files; write a table
first whose order may change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blind_trie import equal_groups
from .common import whole_text

LENGTH = 50
GRAM = 24
SHARD_BYTES = 8_000_000
FAN = 4096
HOT_CONTEXTS = 20_000
NAME_BITS = 47
#: Bytes hashed or compared at once.
PIECE_BYTES = 400_000
#: Strings sorted at once in a task, but for those of one anchor.
SLICE_STRINGS = 400_000
BASE = 0x9E3779B97F4A7C15
LAST_ID = np.iinfo(np.int64).max
_ONE = 1 << 64
_NONE = np.zeros(0, np.int64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, _ONE))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, size of them."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes sum to about most."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hashes of all n-byte strings, by doubling."""
    current, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & width:
            if out is None:
                out, done = current, width
            else:
                size = min(len(out), len(current) - done)
                out, done = out[:size] * _power(width) + current[done : done + size], done + width
        if done == n:
            return _mix(out)
        size = len(current) - width
        current, width = current[:size] * _power(width) + current[width : width + size], 2 * width


def anchors(data: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, last string) of each anchor: the strings from first to last, by their starts, are its own.

    doc: the document of each byte; no string reaches into another one.
    """
    h = gram_hashes(data, gram)
    span, least, width = length - gram + 1, h, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    owner = np.where(doc[: len(least)] == doc[length - 1 :], doc[: len(least)], -1)
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(least)] - 1
    inside = owner[first] >= 0
    first, last = first[inside], last[inside]
    # least hashes crowd at the low end; mixed again they are spread evenly over buckets
    return _mix(least[first] + np.uint64(BASE)), first, last


def string_hashes(text: np.ndarray, begin: np.ndarray, nbytes: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each text[begin:begin + nbytes]."""
    out = np.empty(len(begin), np.uint64)
    power = _powers(BASE, int(nbytes.max(initial=0)))
    for lo, hi in _pieces(nbytes, PIECE_BYTES):
        n = nbytes[lo:hi]
        data = text[_ranges(begin[lo:hi], n)].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = np.add.reduceat(data * power[_ranges(np.zeros(hi - lo, np.int64), n)], np.cumsum(n) - n)
    return _mix(out)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, nbytes: np.ndarray) -> np.ndarray:
    """Whether text[a:a + nbytes] is text[b:b + nbytes], of each."""
    out = np.empty(len(a), bool)
    for lo, hi in _pieces(nbytes, PIECE_BYTES):
        n = nbytes[lo:hi]
        equal = text[_ranges(a[lo:hi], n)] == text[_ranges(b[lo:hi], n)]
        out[lo:hi] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def equal_classes(h: np.ndarray, f: np.ndarray, begin: np.ndarray, nbytes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a class begins there): strings of equal h, f and bytes together, in order of h, f, size, bytes.

    Members of a class keep their order. f is a hash of the bytes and is never trusted.
    """
    order = np.lexsort((nbytes, f, h))
    if not len(order):
        return order, np.zeros(0, bool)
    a, b = order[1:], order[:-1]
    new = np.r_[True, (h[a] != h[b]) | (f[a] != f[b]) | (nbytes[a] != nbytes[b])]
    at = np.flatnonzero(~new)
    differ = at[~same_bytes(text, begin[order[at]], begin[order[at - 1]], nbytes[order[at]])]
    starts = np.flatnonzero(new)
    for c in np.unique(np.searchsorted(starts, differ, side="right") - 1):  # equal hashes of different bytes
        lo, hi = starts[c], starts[c + 1] if c + 1 < len(starts) else len(order)
        members = sorted((text[begin[k] : begin[k] + nbytes[k]].tobytes(), k) for k in order[lo:hi].tolist())
        order[lo:hi] = [k for _, k in members]
        new[lo + 1 : hi] = [x[0] != y[0] for x, y in zip(members[1:], members)]
    return order, new


class Shard:
    """The documents of a shard, their anchors and the classes of equal contexts, numbered by hashes and bytes."""

    def __init__(self, table: pa.Table):
        self.ids = np.array([LAST_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.texts = [(x or "").encode("utf-8", "surrogatepass") for x in table.column("text").to_pylist()]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.base = np.cumsum(size) - size
        found: list[tuple[np.ndarray, ...]] = []
        power, back = (_powers(b, int(size.max(initial=0)) + PIECE_BYTES) for b in (BASE, pow(BASE, -1, _ONE)))
        for lo, hi in _pieces(size, PIECE_BYTES):
            data = self.data[self.base[lo] : self.base[lo] + int(size[lo:hi].sum())]
            if len(data) >= LENGTH:
                doc = np.repeat(np.arange(lo, hi), size[lo:hi])
                h, first, last = anchors(data, doc)
                sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])]
                found.append((h, _mix((sums[last + LENGTH] - sums[first]) * back[first]), first + self.base[lo], last - first + 1, doc[first]))
        none = (_NONE.astype(np.uint64), _NONE.astype(np.uint64), _NONE, _NONE, _NONE)
        self.hash, f, self.begin, self.size, self.doc = map(np.concatenate, zip(*found)) if found else none
        order, new = equal_classes(self.hash, f, self.begin, self.size + LENGTH - 1, self.data)
        at = np.flatnonzero(new)
        #: Of each anchor the number of its class; of each class an anchor, its smallest and its largest id.
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.one = order[at]
        ids = self.ids[self.doc[order]]
        self.low, self.high = (f.reduceat(ids, at) if len(at) else _NONE for f in (np.minimum, np.maximum))
        self.class_hash = self.hash[self.one]

    def strings(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The strings of anchors of these hashes by class of equal ones: (class, context, place in it, begin, hash).

        Sorted by class, the first of a class by context and place first; the hash is that of anchor and string.
        """
        contexts = np.flatnonzero(np.isin(self.class_hash, hashes))
        size = self.size[self.one[contexts]]
        context, place = np.repeat(contexts, size), _ranges(np.zeros(len(size), np.int64), size)
        begin, nbytes = self.begin[self.one[context]] + place, np.full(len(context), LENGTH)
        h, f = self.class_hash[context], string_hashes(self.data, begin, nbytes)
        order, new = equal_classes(h, f, begin, nbytes, self.data)
        return np.cumsum(new) - 1, context[order], place[order], begin[order], _mix(h[order] ^ f[order] * np.uint64(BASE))


def pack(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    """Arrays of one length, byte by byte, and a text, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=5).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *planes, text]))


def unpack(blob: bytes, kinds: tuple[np.dtype, ...]) -> list[np.ndarray]:
    """The arrays of a blob and its text as bytes."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(data[:8].view(np.int64)[0]), 8, []
    for kind in kinds:
        width = kind.itemsize
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return [*out, data[at:]]


def joined(table: pa.Table, kinds: tuple[np.dtype, ...]) -> list[np.ndarray]:
    parts = [unpack(b.as_py(), kinds) for b in table.column("blob")]
    return [np.concatenate(x) for x in zip(*parts)]


_U8, _I8, _I4, _U2 = map(np.dtype, ("<u8", "<i8", "<i4", "<u2"))
#: name << 1 | whether several documents of the shard have it, contexts, shard.
NAME_KINDS = (_U8, _U2, _I4)
#: hash, strings, shard, context, place of a hot anchor's string or -1, smallest id, largest id less the smallest.
CONTEXT_KINDS = (_U8, _I4, _I4, _I4, _I4, _I8, _I8)
_PACKET_SCHEMA = "bucket long, part int, blob binary"


def packets(arrays: list[np.ndarray], text: np.ndarray | None, begin: np.ndarray | None, hash_bits: int, skip: int, bits: int, part: int, fan: int) -> pa.Table:
    """Packets of entries sorted by arrays[0], one for each of the ranges that its top skip + bits bits make.

    With a text, entry k has the arrays[1][k] + LENGTH - 1 bytes from begin[k].
    """
    order = np.argsort(arrays[0], kind="stable")
    arrays = [a[order] for a in arrays]
    key = (arrays[0] >> np.uint64(hash_bits - skip - bits)).astype(np.int64) if skip + bits else np.zeros(len(order), np.int64)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else _NONE
    blobs = []
    for lo, hi in zip(at, np.r_[at[1:], len(key)]):
        cut = b""
        if text is not None:
            cut = text[_ranges(begin[order[lo:hi]], arrays[1][lo:hi].astype(np.int64) + LENGTH - 1)].tobytes()
        blobs.append(pack([a[lo:hi] for a in arrays], cut))
    return pa.table({"bucket": pa.array(key[at], pa.int64()), "part": pa.array(np.full(len(at), part // fan, np.int32)), "blob": pa.array(blobs, pa.binary())})


def _relay(kinds: tuple[np.dtype, ...], hash_bits: int, skip: int, bits: int, fan: int) -> Callable:
    """Regroups packets of one range and fan shards into finer ranges."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *arrays, text = joined(table, kinds)
        begin = None
        if kinds == CONTEXT_KINDS:
            nbytes = arrays[1].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(nbytes) - nbytes
        return packets(arrays, text if begin is not None else None, begin, hash_bits, skip, bits, key[1].as_py(), fan)

    return run


def _hops(bits: int, fan: int) -> list[int]:
    """How many bits of the hash each hop adds."""
    most = max(1, fan.bit_length() - 1)
    return [min(most, bits - k) for k in range(0, bits, most)] or [0]


def _routed(sent: DataFrame, kinds: tuple[np.dtype, ...], hash_bits: int, hops: list[int], fan: int) -> DataFrame:
    for k in range(1, len(hops)):
        sent = sent.groupBy("bucket", "part").applyInArrow(_relay(kinds, hash_bits, sum(hops[:k]), hops[k], fan), _PACKET_SCHEMA)
    return sent


def _send_names(bits: int, fan: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = Shard(table)
        name = shard.class_hash >> np.uint64(64 - NAME_BITS)
        at = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else _NONE
        several = np.maximum.reduceat(shard.high, at) > np.minimum.reduceat(shard.low, at) if len(at) else np.zeros(0, bool)
        n = np.minimum(np.diff(np.r_[at, len(name)]), 65_535).astype(_U2)
        number = key[0].as_py()
        return packets([name[at] << np.uint64(1) | several, n, np.full(len(at), number, _I4)], None, None, NAME_BITS + 1, 0, bits, number, fan)

    return run


def _find_shared(hot_contexts: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name, n, shard, _ = joined(table, NAME_KINDS)
        order = np.argsort(name, kind="stable")
        name, n, shard = name[order], n[order].astype(np.int64), shard[order]
        several, name = (name & np.uint64(1)).astype(bool), name >> np.uint64(1)
        at = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        count = np.diff(np.r_[at, len(name)])
        shared = np.repeat((count > 1) | np.logical_or.reduceat(several, at), count)
        hot = np.repeat(np.add.reduceat(n, at) > hot_contexts, count)
        return pa.table({"shard": pa.array(shard[shared], pa.int32()), "name": pa.array((name << np.uint64(1) | hot)[shared].view(np.int64))})

    return run


def _send_contexts(bits: int, fan: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        shard = Shard(docs)
        known = np.sort(shared.column("name").to_numpy().view(np.uint64)) if shared.num_rows else np.zeros(0, np.uint64)
        name = shard.class_hash >> np.uint64(64 - NAME_BITS)
        place = np.minimum(np.searchsorted(known >> np.uint64(1), name), max(0, len(known) - 1))
        sent = known[place] >> np.uint64(1) == name if len(known) else np.zeros(len(name), bool)
        hot = sent & (known[place] & np.uint64(1)).astype(bool) if len(known) else sent
        c = np.flatnonzero(sent & ~hot)
        parts = [(shard.class_hash[c], shard.size[shard.one[c]], c, np.full(len(c), -1), shard.low[c], shard.high[c], shard.begin[shard.one[c]])]
        if hot.any():
            cls, context, at, begin, h = shard.strings(np.unique(shard.class_hash[hot]))
            first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            low, high = np.minimum.reduceat(shard.low[context], first), np.maximum.reduceat(shard.high[context], first)
            parts.append((h[first], np.ones(len(first), np.int64), context[first], at[first], low, high, begin[first]))
        h, size, context, at, low, high, begin = map(np.concatenate, zip(*parts))
        number = key[0].as_py() if docs.num_rows else 0
        arrays = [h, size.astype(_I4), np.full(len(h), number, _I4), context.astype(_I4), at.astype(_I4), low, high - low]
        return packets(arrays, shard.data, begin, 64, 0, bits, number, fan)

    return run


def smallest_ids(h: np.ndarray, low: np.ndarray, size: np.ndarray, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Smallest id of each string of contexts, size strings each; low is the smallest id that has the context."""
    ids = np.repeat(low, size)
    # only strings of an anchor that has several contexts can have an id other than their context's own
    _, group = np.unique(h, return_inverse=True)
    several = np.bincount(group) > 1
    pick = np.flatnonzero(np.repeat(several[group], size))
    if len(pick):
        k = np.flatnonzero(several[group])
        nbytes = size[k] + LENGTH - 1
        part = text[_ranges(begin[k], nbytes)]
        member, cls = equal_groups(np.repeat(group[k], size[k]), _ranges(np.cumsum(nbytes) - nbytes, size[k]), LENGTH, part)
        if len(member):
            order = np.argsort(cls, kind="stable")
            member, cls = pick[member[order]], cls[order]
            at = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            ids[member] = np.repeat(np.minimum.reduceat(ids[member], at), np.diff(np.r_[at, len(cls)]))
    return ids


def _slices(h: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sorted contexts that hold whole anchors and about SLICE_STRINGS strings each."""
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ends = np.r_[starts[1:], len(h)]
    for lo, hi in _pieces(np.add.reduceat(size, starts), SLICE_STRINGS):
        yield int(starts[lo]), int(ends[hi - 1])


def _sort_contexts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h, size, shard, number, place, low, high, text = joined(table, CONTEXT_KINDS)
    size = size.astype(np.int64)
    nbytes = size + LENGTH - 1
    begin = np.cumsum(nbytes) - nbytes
    # equal contexts of several shards are sorted once
    order, new = equal_classes(h, string_hashes(text, begin, nbytes), begin, nbytes, text)
    at = np.flatnonzero(new)
    one, count = order[at], np.diff(np.r_[at, len(order)])
    least = np.minimum.reduceat(low[order], at)
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi in _slices(h[one], size[one]):
        k = one[lo:hi]
        ids = smallest_ids(h[k], least[lo:hi], size[k], begin[k], text)
        # back to the contexts of each shard, as runs of strings with the same smallest id
        slot = np.cumsum(size[k]) - size[k]
        begins = np.r_[True, ids[1:] != ids[:-1]]
        begins[slot] = True
        start = np.flatnonzero(begins)
        owner = np.searchsorted(slot, start, side="right") - 1
        runs = np.bincount(owner, minlength=hi - lo)
        first_run = np.cumsum(runs) - runs
        to = order[at[lo] : at[lo] + int(count[lo:hi].sum())]
        cls = np.repeat(np.arange(hi - lo), count[lo:hi])
        member, run = np.repeat(to, runs[cls]), _ranges(first_run[cls], runs[cls])
        useful = ids[start[run]] < low[member] + high[member]
        member, run = member[useful], run[useful]
        n = np.diff(np.r_[start, len(ids)])[run]
        single = place[member] >= 0
        out.append((shard[member], number[member], np.where(single, place[member], start[run] - slot[owner[run]]), np.where(single, 0, n), ids[start[run]]))
    cols = [np.concatenate(x) for x in zip(*out)]
    return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("shard", "number", "place", "n", "id"), cols, (*[pa.int32()] * 4, pa.int64()))})


_RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"


def _runs(shard: Shard, found: pa.Table) -> tuple[np.ndarray, ...]:
    """(context, place, strings, smallest id) in order of contexts; those of hot anchors for each place of the string."""
    number, place, n, ids = (found.column(c).to_numpy().astype(np.int64) for c in ("number", "place", "n", "id"))
    hot = n == 0
    if hot.any():
        cls, context, at, *_ = shard.strings(np.unique(shard.class_hash[number[hot]]))
        first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        # a string was sent under its first context and place
        width = int(shard.size.max()) + 1
        names = context[first] * width + at[first]
        order = np.argsort(names)
        c = order[np.searchsorted(names[order], number[hot] * width + place[hot])]
        value = np.full(len(first), LAST_ID)
        value[c] = ids[hot]
        keep = np.isin(cls, c)
        number, place, n, ids = (np.r_[a[~hot], b] for a, b in ((number, context[keep]), (place, at[keep]), (n, np.ones(int(keep.sum()), np.int64)), (ids, value[cls[keep]])))
    order = np.argsort(number, kind="stable")
    return number[order], place[order], n[order], ids[order]


def _cut_texts(with_text: bool) -> Callable:
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        removed: list[list[tuple[int, int]]] = [[] for _ in range(docs.num_rows)]
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in docs.column("text").to_pylist()]
        if found.num_rows:
            shard = Shard(docs)
            number, place, strings, ids = _runs(shard, found)
            lo, hi = np.searchsorted(number, shard.number), np.searchsorted(number, shard.number, side="right")
            anchor, r = np.repeat(np.arange(len(lo)), hi - lo), _ranges(lo, hi - lo)
            smaller = ids[r] < shard.ids[shard.doc[anchor]]
            anchor, r = anchor[smaller], r[smaller]
            start = shard.begin[anchor] + place[r] - shard.base[shard.doc[anchor]]
            end = start + strings[r] - 1 + LENGTH
            order = np.lexsort((start, shard.doc[anchor]))
            for d, i, j in zip(shard.doc[anchor][order].tolist(), start[order].tolist(), end[order].tolist()):
                spans = removed[d]
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(j, spans[-1][1]))
                else:
                    spans.append((i, j))
        kept = []
        for text, spans in zip(texts, removed):
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])))
        return pa.table({
            "doc_id": docs.column("doc_id").cast(pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
            "n_spans": pa.array([len(s) for s in removed], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "spans": pa.array([[{"start": i, "end": j} for i, j in s] for s in removed], span_type),
            "kept": pa.array(kept if with_text else [None] * len(kept), pa.binary()),
        })

    return run


def name_packets(shards, bits: int, fan: int) -> DataFrame:
    """The packets of names after their last hop; shards: documents grouped by shard."""
    hops = _hops(bits, fan)
    return _routed(shards.applyInArrow(_send_names(hops[0], fan), _PACKET_SCHEMA), NAME_KINDS, NAME_BITS + 1, hops, fan)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
    shard_bytes: int = SHARD_BYTES, fan: int = FAN, hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """doc_id (as long), n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept of every row of docs."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    bits = (n_shards - 1).bit_length()  # as many buckets as shards, half as many for names
    dealt = source.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)).cast("int"))
    shards = dealt.groupBy("shard")
    shared = name_packets(shards, max(0, bits - 1), fan).groupBy("bucket").applyInArrow(_find_shared(hot_contexts), "shard int, name long")
    hops = _hops(bits + 1, fan)
    sent = shards.cogroup(shared.groupBy("shard")).applyInArrow(_send_contexts(hops[0], fan), _PACKET_SCHEMA)
    found = _routed(sent, CONTEXT_KINDS, 64, hops, fan).groupBy("bucket").applyInArrow(_sort_contexts, "shard int, number int, place int, n int, id long")
    return shards.cogroup(found.groupBy("shard")).applyInArrow(_cut_texts(with_text), _RESULT_SCHEMA)
