"""Grouping of spelling variants by a symmetric-delete join.

Every word emits the key of itself and of each of its distinct single deletions; words that share a key may differ by
one edit, and an equi-join on the keys finds them all: a word with one code point less is a deletion of the other, and
two words that differ in one place are equal without it. What the join brings together is checked for a distance of
exactly one. A word takes the most frequent of its near words as its form if that is frequent enough, and roots are
found by joining forms to forms until nothing moves; a form is at least RATIO times as frequent as its word, so chains
are short and have no cycles.

A key is 64 bits of a polynomial over the code points, from which the keys of all deletions of a word follow in time
proportional to its length. A key is shared by what one inserted code point makes of one string, so no group grows
with the corpus; words that collide in a key only cost a check.

Edge cases: null texts have no words; words of any length are compared whole; words that no other is near keep a null
form and are their own root; ties go to the smallest word in code-point order; rows that repeat count again; null ids
count as the text `null`; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

RUN_PATTERN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words whose keys a task holds at once.
SLICE_CHARS = 200_000
#: A chain of counts that double has no more links than a long has bits, and each round takes twice as many at once.
MAX_ROUNDS = 8


def word_counts(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n, its occurrences: maximal runs of Latin letters, A-Z lower-cased, each passed through change(id, run) if given."""
    run = F.explode(F.regexp_extract_all(F.translate(whole_text(F.col(text_col)), UPPER, LOWER), F.lit(f"({RUN_PATTERN})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), run.alias("run"))
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    return runs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place in words, and key, of each of the words and of each of their distinct single deletions."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[of]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(1, sizes.max(initial=1)), np.uint64(BASE))]).astype(np.uint64))
        terms = _mixed(codes) * powers[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        whole = sums[starts + sizes] - sums[starts]
        left = sums[np.arange(len(codes))] - sums[starts[of]]
        right = whole[of] - left - terms
        # the deletions within a run of one letter are equal: only the run's last place counts
        last = np.ones(len(codes), bool)
        last[:-1] = (codes[:-1] != codes[1:]) | (of[:-1] != of[1:])
        deleted = (left + right * np.uint64(INVERSE))[last]
    return np.concatenate([np.arange(len(words)), of[last]]), np.concatenate([whole, deleted]).view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    """key, word and n: a row for each word and for each of its distinct single deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, start, chars = batch.column(0).to_pylist(), 0, 0
            for k, w in enumerate(found):
                chars += len(w)
                if chars >= SLICE_CHARS or k == len(found) - 1:
                    part = batch.slice(start, k + 1 - start)
                    of, keys = delete_keys(found[start : k + 1])
                    at = pa.array(of)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(at), part.column(1).take(at)], ["key", "word", "n"])
                    start, chars = k + 1, 0

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all pairs of words that differ by one code point, in both orders, each once."""
    keys = keyed(words)
    a = keys.select("key", "word", "n")
    b = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    one_apart = (F.col("word") < F.col("other")) & (F.abs(F.char_length("word") - F.char_length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    met = cut(a.join(b, "key").filter(one_apart).select("word", "n", "other", "other_n").distinct())
    return met.unionByName(met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row (word, form): where following forms ends."""
    chain = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(chain.join(onward, "root", "left"))
        chain = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.filter("further IS NOT NULL").isEmpty():
            return chain
    raise RuntimeError("forms did not end")


def spelling_variants(counts: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row (word, n) of counts with enough code points and occurrences."""
    words = cut(counts.filter((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)))
    near = near_pairs(words).groupBy("word").agg(
        F.first("n").alias("n"),
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("fewer"), "other")).alias("best"),
    )
    enough = -F.col("best.fewer") >= ratio * F.col("n")
    formed = cut(near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.fewer")).alias("form_n")))
    ends = roots(formed.filter("form IS NOT NULL"))
    return (
        words.join(formed, "word", "left")
        .join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
