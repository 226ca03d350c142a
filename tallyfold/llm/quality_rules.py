"""Quality rules: a threshold table compiled into one projection of built-in functions.

Edge cases: a null or empty text has no words and fails the base rule; a repeated row is judged as often as
it occurs; columns other than the id and the text are ignored, so clashing names do no harm; an empty table
gives an empty result; a null id is passed through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, whole_text

SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "are", "this", "from", "at",
    "der", "die", "und", "das", "von", "den", "mit", "zu", "im", "nicht", "ein", "eine", "auf", "für", "dem", "des", "sich", "als",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "par", "sur", "qui", "au",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "una", "su", "al", "lo", "como", "no",
)

STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """The metric must lie in [low, high]; a null metric (no words, no lines) passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.25),
    Rule("stop_word_share", "stop_word_share", 0.06, None),
    Rule("duplicate_line_share", "dup_line_share", None, 0.35),
    Rule("repeated_word_share", "repeat_word_share", None, 0.5),
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _mix(a: Column, b: Column) -> Column:
    """A hash of two hashes, in their order; it can't overflow."""
    return F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text; whole-text built-ins only, no shuffle."""
    blank = F.lit(SPACE_CHARS)
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("t"))
    base = base.withColumn("w", F.when(F.length(F.btrim("t", blank)) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(F.btrim("t", blank), SPACE_PATTERN, -1)))
    base = base.select(
        "doc_id", "w",
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, blank)) > 0).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # a cheap sieve first: where no two windows of word hashes are equal, no two windows are
    windows = F.greatest(F.size("w") - 2, F.lit(0))
    hashed = F.zip_with(F.zip_with(F.slice("h", 1, windows), F.slice("h", 2, windows), _mix), F.slice("h", 3, windows), _mix)
    base = base.select(
        "doc_id", "w", "n_symbols",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("windows"),
    )
    nothing = F.expr("cast(array() as array<struct<g:string,p:int>>)")
    n = F.greatest(F.size("w") - 2, F.lit(0))
    zipped = F.arrays_zip(*(F.slice("w", i, n).alias(f"w{i}") for i in (1, 2, 3)))
    placed = F.sort_array(F.transform(zipped, lambda z, i: F.struct(F.concat_ws(" ", z["w1"], z["w2"], z["w3"]).alias("g"), i.alias("p"))))
    base = base.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(nothing)).drop("windows", "w")
    # equal windows are neighbours once sorted; a pair of equal neighbours marks the places of both
    n = F.greatest(F.size("placed") - 1, F.lit(0))
    pairs = F.filter(F.arrays_zip(F.slice("placed", 1, n).alias("a"), F.slice("placed", 2, n).alias("b")), lambda z: z["a"]["g"] == z["b"]["g"])
    marked = F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["a"]["p"], z["b"]["p"]))))
    words = F.array_distinct(F.flatten(F.transform(marked, lambda p: F.array(p, p + 1, p + 2))))
    return base.withColumn("n_repeat_words", F.size(words).cast("long")).drop("placed")


def verdict_columns(rules: Sequence[Rule] = RULES) -> list[Column]:
    """The threshold table as columns over metrics(): base_failed, failed_rules, kept."""
    ratio = {
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_share": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_share": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_word_share": _ratio(F.col("n_repeat_words"), F.col("n_words")),
    }

    def broken(rule: Rule) -> Column:
        value = ratio[rule.metric]
        sides = [value < F.lit(rule.low)] * (rule.low is not None) + [value > F.lit(rule.high)] * (rule.high is not None)
        return F.coalesce(reduce(lambda a, b: a | b, sides, F.lit(False)), F.lit(False))

    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.concat_ws(",", *(F.when(broken(r), F.lit(r.name)) for r in rules))
    return [base_failed.alias("base_failed"), failed.alias("failed_rules"), (~base_failed & (failed == "")).alias("kept")]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of docs: the counts, base_failed, the names of the rules it breaks and kept."""
    m = metrics(docs, id_col, text_col)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    return m.select("doc_id", *counts, *verdict_columns(rules))
