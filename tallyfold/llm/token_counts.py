"""Token counts of a `tokenizers` file: pieces are counted once per distinct pre-token, never as ids of a document.

A first reading gathers the distinct pre-tokens with the number of documents that hold each, and the tokenizer's model
cuts each of them once. A second reading gives the pre-tokens of each document with their frequencies; the counts are
joined to them and summed. Pre-tokens that make up over 1 / HOT_SHARE of all (document, pre-token) pairs, HOT_SHARE of
them at most and of HOT_CHARS characters at most (or over 1 / LONG_SHARE, if longer), are joined where a document is
read, so that most pairs are summed before anything is shuffled; the others are written with their document and meet
their counts in a shuffled join, in which no short pre-token has more than that share.

Special strings inside texts are one token each, as the library has it by default. A tokenizer that trims or matches
them in another way, cuts texts off or pads them raises ValueError.

Edge cases: null texts count as empty; empty texts have no tokens; every row is a document of its own, whether its id
repeats or not; null ids are documents like others; a word of any
length is one pre-token; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

HOT_SHARE, HOT_CHARS = 1 << 19, 32
LONG_SHARE, LONG_CHARS = 1 << 10, 4096
MAX_TOKENS = 2048
CACHE_CHUNKS = 300_000
CACHED_CHARS = 48
#: Documents that a task turns into rows at once.
SLICE = 200

_CHUNK = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_PROBE = " Aé  b's\n«x»\t12.5 'll\r\n"
#: Letters and texts in which normal forms, lower case and character classes are the same for every library.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[\x20-\x7E\t\n\x0b\x0c\rÀ-ÖØ-öø-ÿ]*")


def _plain_pattern(told: dict) -> str | None:
    """The pattern of pre-tokens in lower-cased plain text, if that is all the tokenizer looks at; else None."""
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    lowers = [s["type"] for s in steps if s["type"] != "Replace" or (s["pattern"], s["content"]) != ({"Regex": "\\s+"}, " ")] == ["NFC", "Lowercase"]
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if not lowers or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, by_bytes = cuts
    if split["behavior"] != "Removed" or not split["invert"] or by_bytes["add_prefix_space"] or by_bytes["use_regex"]:
        return None
    pattern = split["pattern"].get("Regex")
    return pattern and pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", "0-9")


class PreTokens:
    """The pre-tokens of a text, and the number of pieces of a pre-token."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode("utf-8"))
        told = json.loads(file)
        added = told.get("added_tokens", [])
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or told.get("truncation") or told.get("padding"):
            raise ValueError("this tokenizer trims, matches or cuts in a way that isn't counted here")
        self.special = {t["content"] for t in added}
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split = re.compile("(" + "|".join(longest_first) + ")").split if self.special else lambda t: [t]
        self.known: dict[str, list[str]] = {}
        pattern = _plain_pattern(told)
        self.plain = re.compile(pattern).findall if pattern else None
        if pattern:
            letters = (c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
            self.by_bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        parts = [p for c in _CHUNK.findall(_PROBE) for p in self.cut(c)]
        #: Texts are cut at white space first if no pre-token holds or crosses it.
        self.chunks = _CHUNK.findall if parts == self.cut(_PROBE) else lambda t: [t] if t else []

    def cut(self, text: str) -> list[str]:
        found: list[str] = []
        for part in self.split(text):
            if part in self.special:
                found.append(part)
            elif part:
                normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
                plain = normal.normalize_str(part) if normal else part
                if plain:
                    found += [p for p, _ in pre.pre_tokenize_str(plain)] if pre else [plain]
        return found

    def is_plain(self, text: str) -> bool:
        return self.plain is not None and _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.special)

    def plain_frequencies(self, text: str) -> Counter[str]:
        found = Counter(self.plain(text.lower()))
        if text.isascii():
            return found
        return Counter({p if p.isascii() else p.translate(self.by_bytes): n for p, n in found.items()})

    def look_up(self, chunk: str) -> list[str]:
        found = self.known.get(chunk)
        if found is None:
            found = self.cut(chunk)
            if len(chunk) <= CACHED_CHARS:
                if len(self.known) >= CACHE_CHUNKS:
                    self.known.clear()
                self.known[chunk] = found
        return found

    def frequencies(self, text: str) -> Counter[str]:
        if self.is_plain(text):
            return self.plain_frequencies(text)
        total: Counter[str] = Counter()
        for chunk, n in Counter(self.chunks(text)).items():
            for p in self.look_up(chunk):
                total[p] += n
        return total

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token in self.special else len(self.tokenizer.model.tokenize(pre_token))


_known: dict[str, PreTokens] = {}


def _pre_tokens(file: Broadcast) -> PreTokens:
    """One for each Python worker and tokenizer."""
    data = file.value
    name = hashlib.sha256(data).hexdigest()
    if name not in _known:
        _known[name] = PreTokens(data)
    return _known[name]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE))


def vocabulary(docs: DataFrame, file: Broadcast, text_col: str = "text") -> DataFrame:
    """pre, n_docs (documents that hold it) and pieces of every distinct pre-token of docs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _pre_tokens(file)
        for batch in batches:
            held: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                held.update(of.frequencies(text or "").keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre", "n_docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _pre_tokens(file)
        for batch in batches:
            pieces = pa.array([of.pieces(p) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["pre", "n_docs", "pieces"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gather, "pre string, n_docs long")
    return found.groupBy("pre").agg(F.sum("n_docs").alias("n_docs")).mapInArrow(count, "pre string, n_docs long, pieces long")


def frequencies(docs: DataFrame, file: Broadcast, hot: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, known and rare of each row of docs.

    known is the number of pieces of its hot pre-tokens, rare the others with their frequencies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pieces = _pre_tokens(file), hot.value
        for batch in _slices(batches):
            sizes, known, starts, pres, counts = [], [], [0], [], []
            for text in batch.column(1).to_pylist():
                total = 0
                for p, n in of.frequencies(text or "").items():
                    found = pieces.get(p)
                    if found is None:
                        pres.append(p)
                        counts.append(n)
                    else:
                        total += n * found
                sizes.append(len((text or "").encode()))
                known.append(total)
                starts.append(len(pres))
            rare = pa.StructArray.from_arrays([pa.array(pres, pa.string()), pa.array(counts, pa.int64())], ["pre", "n"])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "known", "rare"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, known long, rare array<struct<pre:string,n:bigint>>")


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every row of docs."""
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, "rb") as f:
        # the tokenizer's file (some 4 MB, whatever the input) for every executor
        file = sc.broadcast(f.read())
    counts = cut(vocabulary(docs, file, text_col))
    pairs = counts.agg(F.sum("n_docs")).first()[0] or 0
    length = F.char_length("pre")
    often = ((F.col("n_docs") * HOT_SHARE > pairs) & (length <= HOT_CHARS)) | ((F.col("n_docs") * LONG_SHARE > pairs) & (length <= LONG_CHARS))
    # HOT_SHARE short ones and LONG_SHARE long ones at most
    hot = sc.broadcast({r["pre"]: r["pieces"] for r in counts.filter(often).select("pre", "pieces").toLocalIterator()})
    read = cut(frequencies(docs, file, hot, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    rare = read.select("row", F.inline("rare")).join(counts, "pre").select("row", F.lit(None).cast(read.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n"))
    each = read.select("row", "doc_id", "n_bytes", F.col("known").alias("n")).unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
