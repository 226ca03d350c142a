"""Language ID by interpolated Kneser-Ney character models, one per language, kept in sorted hash arrays.

A model sees the letters of one word at a time between two word marks; a word is a letter with the letters and
combining marks that follow it, so numerals are none. Each n-gram is a 64-bit polynomial hash; the hashes of an order
are one sorted array shared by all languages, beside it a log probability and a back-off weight for each language.
The lowest order is interpolated with equal shares for the symbols of the language and one more for all unseen
letters, so the probabilities after any context sum to one. A text gets the language of lowest cross-entropy per letter.

It is rejected if it has no letter, or if its cross-entropy is higher than chance allows: the distance from the mean of
the language, in standard deviations for a text of its length (variance a + b / length, fitted on texts that the models
didn't see), is compared with a limit that FALSE_REJECTS of such texts exceed at most, plus REJECT_MARGIN.

The models are fitted on a bounded sample: about SAMPLE_DOCS whole documents of each language, by a hash of the id, and
about as many others calibrate. A language of fewer than CALIBRATED_DOCS documents learns from all of them; it, and any
other without calibration texts of its own, has mean and variance of all calibration texts. All documents are scored.

Edge cases: null texts and texts without letters are `und` with score 0 and rejected; rows without a language are
scored, never learned from; equal scores go to the first language in code point order; without any labelled row
every text is `und`; if no language has calibration texts, only texts without letters are rejected; other columns are
ignored; repeated rows are scored as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
SAMPLE_DOCS = 800
DISCOUNT = 0.75
#: Letters at most by which a text's evidence counts in its score.
EVIDENCE = 60
#: Share of calibration texts that the limit of rejection lets go at most, and standard deviations added to it.
FALSE_REJECTS = 0.001
REJECT_MARGIN = 1.0
#: Least standard deviation of a text's cross-entropy.
LEAST_SD = 0.03
#: Languages with fewer documents set none aside for calibration.
CALIBRATED_DOCS = 10
CACHE_WORDS = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MARK = 1
UNSEEN = np.uint64(0)
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"


def ngram_hashes(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1..order-grams that end at each letter (0 where the word is too short), their word, their place.

    Places count from 1; place 0 is the opening mark, which is never predicted.
    """
    text = "".join(f"\x01{w}\x01" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    rows, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, order + 1):
        h = np.r_[np.uint64(0), h[:-1]] * BASE + code + np.uint64(7)
        rows.append(np.where(place >= n - 1, h, np.uint64(0)))
    return rows, word, place


def fit_counts(words: list[str], counts: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> list[pd.DataFrame]:
    """Kneser-Ney tables of one language: for each order hash, logp, backoff of the seen n-grams, and of UNSEEN.

    n-grams of the full order, or that begin at the opening mark, have their counts; others count the different
    letters seen before them.
    """
    grams, word, place = ngram_hashes(words, order)
    weight = counts[word].astype(np.float64)
    first = place == 0
    tables: list[pd.DataFrame] = []
    lower = None
    for n in range(1, order + 1):
        at = place >= max(1, n - 1)
        full = at & (place == n - 1) | (at if n == order else np.zeros(len(at), bool))
        raw = pd.DataFrame({"hash": grams[n - 1][full], "c": weight[full]}).groupby("hash")["c"].sum()
        if n < order:
            longer = np.unique(np.stack([grams[n][at & (place >= n)], grams[n - 1][at & (place >= n)]]), axis=1)[1]
            raw = raw.add(pd.Series(*np.unique(longer, return_counts=True)[::-1]).rename("c").astype(float), fill_value=0.0)
        info = pd.DataFrame({"hash": grams[n - 1][at], "low": grams[n - 2][at] if n > 1 else 0, "ctx": np.r_[np.uint64(0), grams[n - 2][:-1]][at] if n > 1 else 0}).drop_duplicates("hash").set_index("hash")
        t = info.join(raw.rename("c"), how="inner")
        t = t[t["c"] > 0]
        total, kinds = t.groupby("ctx")["c"].sum(), t.groupby("ctx")["c"].count()
        gamma = discount * kinds / total
        # whatever ends an n-gram has been seen one order lower
        base = lower["p"].reindex(t["low"]).to_numpy() if n > 1 else np.full(len(t), 1.0 / (len(t) + 1))
        t["p"] = (t["c"] - discount) / total.reindex(t["ctx"]).to_numpy() + gamma.reindex(t["ctx"]).to_numpy() * base
        if n > 1:
            tables[-1]["backoff"] = np.log(gamma.reindex(tables[-1]["hash"])).fillna(0.0).to_numpy()
        lower = t
        tables.append(pd.DataFrame({"hash": t.index.to_numpy(np.uint64), "logp": np.log(t["p"]).to_numpy(), "backoff": 0.0}))
        if n == 1:
            # the opening mark is a context but is never predicted
            mark = pd.DataFrame({"hash": np.unique(grams[0][first]), "logp": 0.0, "backoff": 0.0})
            unseen = pd.DataFrame({"hash": [UNSEEN], "logp": [float(np.log(gamma.iloc[0] / (len(t) + 1)))], "backoff": [0.0]})
            tables[-1] = pd.concat([tables[-1], mark[~mark["hash"].isin(tables[-1]["hash"])], unseen], ignore_index=True)
    return tables


@dataclass
class LanguageModel:
    langs: list[str]
    keys: list[np.ndarray]  # by order, sorted
    logp: list[np.ndarray]  # by order, (keys, langs); NaN: not seen
    backoff: list[np.ndarray]
    unseen: np.ndarray  # by language
    #: By language the mean of the cross-entropy and the a and b of its variance a + b / letters; the limit; None: open.
    spread: np.ndarray | None = None
    limit: float = np.inf

    def __post_init__(self):
        self.cache: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.langs)), np.float64)

    @classmethod
    def of(cls, langs: list[str], rows: pd.DataFrame) -> LanguageModel:
        """From rows (lang, n, hash as signed long, logp, backoff)."""
        place = {x: k for k, x in enumerate(langs)}
        keys, logp, backoff = [], [], []
        for n in range(1, ORDER + 1):
            part = rows[(rows["n"] == n) & (rows["hash"] != UNSEEN)]
            h = part["hash"].to_numpy(np.int64).view(np.uint64)
            k = np.unique(h)
            at, col = np.searchsorted(k, h), part["lang"].map(place).to_numpy(int)
            p, b = np.full((len(k), len(langs)), np.nan, np.float32), np.zeros((len(k), len(langs)), np.float32)
            p[at, col], b[at, col] = part["logp"], part["backoff"]
            keys.append(k)
            logp.append(p)
            backoff.append(b)
        return cls(langs, keys, logp, backoff, rows[rows["hash"] == UNSEEN].set_index("lang")["logp"].reindex(langs).fillna(np.log(1e-6)).to_numpy())

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by each language."""
        grams, word, place = ngram_hashes(words, ORDER)
        p = np.tile(self.unseen, (len(word), 1))
        context = None
        for n in range(1, ORDER + 1):
            k = self.keys[n - 1]
            at = np.minimum(np.searchsorted(k, grams[n - 1]), max(0, len(k) - 1))
            seen = (k[at] == grams[n - 1]) & (place >= n - 1) if len(k) else np.zeros(len(word), bool)
            own = np.where(seen[:, None], self.logp[n - 1][at], np.nan) if len(k) else np.full_like(p, np.nan)
            longer = place >= n - 1
            lower = p + context if context is not None else p
            p = np.where(np.isnan(own), np.where(longer[:, None], lower, p), own)
            back = np.where(seen[:, None], self.backoff[n - 1][at], 0.0) if len(k) else np.zeros_like(p)
            context = np.vstack([np.zeros((1, len(self.langs))), back[:-1]])
        p[place == 0] = 0.0
        ends = np.flatnonzero(place == 0)
        return np.add.reduceat(p, ends, axis=0) if len(ends) else p

    def _place(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        at = np.fromiter((cache.get(w, -1) for w in words), np.int64, len(words))
        if (at < 0).any():
            new = list(dict.fromkeys(w for w, k in zip(words, at) if k < 0))
            start = len(cache)
            cache.update(zip(new, range(start, start + len(new))))
            if start + len(new) > len(self.sums):
                grown = np.zeros((2 * (start + len(new)), len(self.langs)))
                grown[: len(self.sums)] = self.sums
                self.sums = grown
            for k in range(0, len(new), 20_000):
                self.sums[start + k : start + min(k + 20_000, len(new))] = self.word_scores(new[k : k + 20_000])
            at = np.fromiter((cache[w] for w in words), np.int64, len(words))
        return at

    def entropy(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cross-entropy by language in nats per letter or word mark, and how many of them; None without letters."""
        words = LETTERS.findall((text or "").lower())
        if not words or not self.langs:
            return None, 0
        total = np.zeros(len(self.langs))
        for k in range(0, len(words), 50_000):
            at = self._place(words[k : k + 50_000])
            total += self.sums[at].sum(axis=0)
        n = sum(map(len, words)) + len(words)
        return -total / n, n

    def classify(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy, rejected."""
        e, n = self.entropy(text)
        if e is None:
            return UNDETERMINED, 0.0, None, True
        best = int(np.argmin(e))
        odds = np.exp(-(e - e[best]) * min(n, EVIDENCE))
        return self.langs[best], float(1 / odds.sum()), float(e[best]), self.distance(best, e[best], n) > self.limit

    def distance(self, lang: int, e: float, n: int) -> float:
        """Standard deviations from the mean of a text of n letters in this language."""
        if self.spread is None:
            return 0.0
        mean, a, b = self.spread[lang]
        return float((e - mean) / np.sqrt(max(a + b / n, LEAST_SD**2)))


def variance_line(e: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Mean of cross-entropies e of texts of n letters, and a, b >= 0 of the variance a + b / n by least squares."""
    mean = float(np.average(e, weights=n / (n + EVIDENCE)))
    square, x = (e - mean) ** 2, 1.0 / n
    vx = float(np.average((x - x.mean()) ** 2))
    b = max(0.0, float(np.average((x - x.mean()) * (square - square.mean()))) / vx) if vx > 0 else 0.0
    a = float(square.mean()) - b * float(x.mean())
    return (mean, a, b) if a >= 0 else (mean, 0.0, float(square.mean() / x.mean()))


def _fit_language(pdf: pd.DataFrame) -> pd.DataFrame:
    tables = fit_counts(pdf["word"].tolist(), pdf["n"].to_numpy())
    out = pd.concat([t.assign(n=k + 1) for k, t in enumerate(tables)], ignore_index=True)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "n": out["n"].astype("int32"), "hash": out["hash"].to_numpy(np.uint64).view(np.int64), "logp": out["logp"], "backoff": out["backoff"]})


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Models of the languages of docs from about sample_docs documents each.

    The model's size is bounded by the sample, not by docs.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], [np.zeros(0, np.uint64)] * ORDER, [np.zeros((0, 0))] * ORDER, [np.zeros((0, 0))] * ORDER, np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5))
    rare = [x for x in langs if sizes[x] < CALIBRATED_DOCS]
    folded = labelled.withColumn("fold", F.when(F.col("lang").isin(rare), F.lit(1)).otherwise(fold))

    def about(part: float) -> Column:
        """Whether a row is among about sample_docs of the part of its language."""
        shares = F.create_map(*(F.lit(v) for x in langs for v in (x, min(1.0, sample_docs / (part * sizes[x])))))
        return draw < F.element_at(shares, F.col("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found.update((lang, w) for w in LETTERS.findall(text.lower()))
        rows = [(*k, n) for k, n in found.items()]
        for k in range(0, len(rows), 20_000):
            yield pd.DataFrame(rows[k : k + 20_000], columns=["lang", "word", "n"])

    counted = folded.filter((F.col("fold") != 0) & about(0.8)).select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInPandas(_fit_language, "lang string, n int, hash long, logp double, backoff double").toPandas()
    model = LanguageModel.of(langs, rows)
    held = folded.filter((F.col("fold") == 0) & about(0.2)).select("lang", "text")

    def entropies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(x, *model.entropy(t)) for x, t in zip(pdf["lang"], pdf["text"])]
            yield pd.DataFrame([(x, float(e[langs.index(x)]), n) for x, e, n in found if e is not None], columns=["lang", "e", "n"])

    seen = held.mapInPandas(entropies, "lang string, e double, n long").toPandas()  # about sample_docs rows a language
    if len(seen):
        lines = {x: variance_line(part["e"].to_numpy(), part["n"].to_numpy(float)) for x, part in seen.groupby("lang")}
        pooled = variance_line(seen["e"].to_numpy(), seen["n"].to_numpy(float))
        model.spread = np.array([lines.get(x, pooled) for x in langs])
        far = np.sort([model.distance(langs.index(x), e, n) for x, e, n in zip(seen["lang"], seen["e"], seen["n"])])
        model.limit = float(far[min(len(far), int(np.ceil((len(far) + 1) * (1 - FALSE_REJECTS)))) - 1]) + REJECT_MARGIN
    return model


def classify(docs: DataFrame, model: LanguageModel, keep: tuple[Column | str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns to keep with lang_pred, score, entropy and rejected of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [m.classify(t.as_py()) for t in batch.column(len(names))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names, "lang_pred", "score", "entropy", "rejected"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, lang_pred string, score double, entropy double, rejected boolean")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the row's fold, by CRC32 of its id as text, is the one that isn't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected of every row of docs; held-out rows aren't learned from."""
    model = fit(docs.filter(~held_out(id_col)), lang_col, id_col, text_col)
    return classify(docs, model, (F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")), text_col)
