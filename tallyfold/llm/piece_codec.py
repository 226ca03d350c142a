"""Encoding and decoding with a BPE SentencePiece model, exactly as its library does, without calling it on texts.

Merge-type encoding by backtracking: Aho-Corasick finds all vocabulary pieces of a span, the longest at the current
place is tried first, a piece may follow another only if re-merging the two together gives the same two, and a
bitfield holds the places from which no sequence of pieces reaches the end. A place whose two neighbouring characters
stand side by side in no piece can't be inside a merged piece, so texts are cut there and each distinct span is
encoded once while it stays in a cache of bounded size.

Works for models with identity normalisation, a dummy prefix and byte fallback, like the one this was built for; a
model of another kind raises ValueError.

Edge cases: null texts count as empty; an empty text has no ids and decodes to itself; U+2581 in a text is read as a
space, as in the library; other columns are ignored; repeated rows are encoded as often as they occur; an empty
table gives an empty result; null ids are passed through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NEVER = float("-inf")
CACHE_SPANS = 700_000
CACHED_CHARS = 48


class PieceCodec:
    def __init__(self, model_bytes: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = sp.get_piece_size()
        if sp.normalize("  Aﬁ  b ") != f"{SPACE}{SPACE} Aﬁ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("this codec needs identity normalisation with a dummy prefix")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("this codec needs byte fallback")
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(self.pieces):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this codec needs pieces with spaces at their start only")
        self.chars = {c for p in self.ids for c in p}
        #: Second characters by first character, of all neighbours inside pieces.
        inside: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                inside.setdefault(a, set()).add(b)
        self.inside = inside
        # pieces that merging can't make from their own characters are never part of an encoding
        self.real = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.real.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.span_cache: dict[str, tuple[int, str, str]] = {}
        # cuts: before a space that follows anything else, and around characters that merge with nothing on that side
        self.first = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """The pieces by repeated best merges, leftmost among equals."""
        parts, score = list(text), self.score
        pairs = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            k = pairs.index(best)
            parts[k : k + 2] = [joined := parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score.get(parts[k - 1] + joined, NEVER)
            if k < len(pairs):
                pairs[k] = score.get(joined + parts[k + 1], NEVER)
        return parts

    def fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.fits.get(key)) is None:
            pa_, pb = self.pieces[a], self.pieces[b]
            known = self.fits[key] = pb[0] not in self.inside.get(pa_[-1], ()) or self.merge(pa_ + pb) == [pa_, pb]
            if len(self.fits) > 2_000_000:
                self.fits = {key: known}
        return known

    def _known(self, span: str) -> list[int]:
        """Ids of a span of vocabulary characters, by backtracking."""
        whole = self.real.get(span)
        if whole is not None:
            return [whole]
        n = len(span)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(span):
            at[end + 1 - match[0]].append(match)  # ends ascend, so lengths at a place ascend
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        lengths: list[int] = []
        left: list[int] = []  # how many shorter matches remain untried at the place of each piece
        pos, tries, fits = 0, len(at[0]), self.fits
        while pos < n:
            row, placed = at[pos], False
            while tries:
                tries -= 1
                length, piece = row[tries]
                end = pos + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if out and not (fits[k] if (k := out[-1] << 20 | piece) in fits else self.fit(out[-1], piece)):
                    continue
                out.append(piece)
                lengths.append(length)
                left.append(tries)
                pos, placed = end, True
                break
            if placed:
                tries = len(at[pos]) if pos < n else 0
                continue
            failed[pos >> 3] |= 1 << (pos & 7)
            if not out:
                raise ValueError(f"no encoding of {span!r}")
            out.pop()
            pos -= lengths.pop()
            tries = left.pop()
        return out

    def _cut(self, span: str) -> list[str]:
        inside, parts, start = self.inside, [], 0
        for k in range(1, len(span)):
            if span[k] not in inside.get(span[k - 1], ()):
                parts.append(span[start:k])
                start = k
        parts.append(span[start:])
        return parts

    def encode_span(self, span: str) -> list[int]:
        ids: list[int] = []
        for part in self._cut(span):
            if part in self.real:
                ids.append(self.real[part])
            elif len(part) == 1:  # a character without a piece stands alone: its neighbours are in no piece either
                ids.extend(self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass"))
            else:
                ids.extend(self._known(part))
        return ids

    def decode_pieces(self, ids: list[int]) -> str:
        """The pieces of ids as text, bytes joined to UTF-8 and spaces shown, the dummy prefix still there."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.id_bytes.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def spans(self, text: str) -> list[str]:
        return self.first.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def look_up(self, span: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and what they decode to."""
        ids = self.encode_span(span)
        found = (len(ids), ",".join(map(str, ids)), self.decode_pieces(ids))
        if len(span) <= CACHED_CHARS:
            if len(self.span_cache) >= CACHE_SPANS:
                self.span_cache.clear()
            self.span_cache[span] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for span in self.spans(text) for i in self.encode_span(span)]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        return text[1:] if text[:1] == " " and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        cache, found = self.span_cache, []
        for span in self.spans(text):
            found.append(cache.get(span) or self.look_up(span))
        # the first piece of a text starts with the dummy prefix, which decoding takes off again
        n = sum([f[0] for f in found])
        ids = ",".join([f[1] for f in found])
        decoded = "".join([f[2] for f in found])[1:]
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


_codecs: dict[str, PieceCodec] = {}


@contextmanager
def _codec(model: Broadcast) -> Iterator[PieceCodec]:
    """One codec for each Python worker and model; its cache goes with the task, since workers wait idle through later stages."""
    data = model.value
    name = hashlib.sha256(data).hexdigest()
    if name not in _codecs:
        _codecs[name] = PieceCodec(data)
    try:
        yield _codecs[name]
    finally:
        _codecs[name].span_cache.clear()


def _ship(docs: DataFrame, model_path: str) -> Broadcast:
    """The model's bytes (some 500 KB, whatever the input) for every executor."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row of docs."""
    model = _ship(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(model) as codec:
            for batch in batches:
                ids = [codec.encode(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row (doc_id, ids); null ids decode to the empty text."""
    model = _ship(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(model) as codec:
            for batch in batches:
                texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs, encoded and decoded in one pass."""
    model = _ship(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(model) as codec:
            for batch in batches:
                for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                    rows = [codec.summary(t or "") for t in part.column(1).to_pylist()]
                    columns = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
