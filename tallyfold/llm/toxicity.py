"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, fitted on document labels.

A sentence's probability is logistic in the words it holds and their prefixes; a document is toxic unless none of its
sentences is: 1 - prod(1 - p). Only document labels are learned from, yet each sentence gets its own probability, so
the offending ones can be shown.

Fitted on a bounded sample of labelled documents (SAMPLE_TOXIC toxic and SAMPLE_OTHER others at most, about, by a hash
of the id); four fifths fit the weights, one fifth places the threshold. All features that MIN_DOCS toxic documents of
the sample have, and MIN_RATIO times as often as others, get a weight, so the sample alone bounds the model. All
documents are scored, whole.

Edge cases: null texts count as empty; an empty text has no sentence and the lowest score of the model; documents
without a label, or with a null one, are scored, never learned from; several labels of a document count as toxic if
any does; without labels of both kinds every score is 0; other columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE_TOXIC = 2500
SAMPLE_OTHER = 3500
PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS = 4
MIN_RATIO = 2.5
STEPS = 250
RATE = 0.08
PENALTY = 2e-4
THRESHOLD = 0.7
CACHE_WORDS = 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word and its prefixes, told apart by a mark."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if n <= len(word))]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    #: Logit of the document probability that becomes a score of THRESHOLD; None: nothing was learned.
    cut: float | None = None

    def __post_init__(self):
        self.cache: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        w = self.cache.get(word)
        if w is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            w = self.cache[word] = fsum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with a word."""
        out, weight = [], self.word_weight
        for m in SENTENCE.finditer(text.lower()):
            if words := set(WORD.findall(m.group())):
                out.append((m.start(), m.end(), self.bias + fsum(map(weight, words))))
        return out

    def logit(self, logits: np.ndarray) -> float:
        """Logit of the noisy-or of sentence logits."""
        s = max(float(softplus(logits).sum()), 1e-12)
        return float(s + np.log(-np.expm1(-s)))  # log((1 - e^-s) / e^-s)

    def score(self, logits: np.ndarray) -> float:
        if self.cut is None:
            return 0.0
        z = self.logit(logits) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def choose_features(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> list[str]:
    """Features that toxic documents have MIN_RATIO times as often as others, strongest first."""
    ratio = {f: (c / max(1, n_pos)) / ((neg.get(f, 0) + 1) / (n_neg + 1)) for f, c in pos.items() if c >= MIN_DOCS}
    return sorted((f for f, r in ratio.items() if r >= MIN_RATIO), key=lambda f: (-ratio[f] * pos[f], f))


def known_features(text: str, index: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Number of sentences with a word, and (sentence, feature) of the chosen features in them."""
    n, sent, feat = 0, [], []
    for s in SENTENCE.findall(text.lower()):
        if words := set(WORD.findall(s)):
            known = sorted({k for w in words for f in features(w) if (k := index.get(f)) is not None})
            sent += [n] * len(known)
            feat += known
            n += 1
    return n, sent, feat


def loss_and_gradient(w: np.ndarray, b: float, sent_of: np.ndarray, feat: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray, fitted: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of the noisy-or of the fitted documents with the penalty, and its gradient in (w, b).

    sent_of and feat: a sentence and a feature that stands in it; doc_of: the document of each sentence.
    """
    z = b + np.bincount(sent_of, w[feat], minlength=len(doc_of)) if len(feat) else np.full(len(doc_of), b)
    s = np.maximum(np.bincount(doc_of, softplus(z), minlength=len(toxic)), 1e-9)
    pull = np.where(toxic, -1 / np.expm1(s), 1.0)
    dz = np.where(fitted[doc_of], pull[doc_of] / (1 + np.exp(-z)), 0.0)
    loss = np.where(toxic, -np.log(-np.expm1(-s)), s)[fitted].sum() / fitted.sum() + PENALTY / 2 * (w**2).sum()
    return float(loss), np.r_[np.bincount(feat, dz[sent_of], minlength=len(w)) / fitted.sum() + PENALTY * w, dz.sum() / fitted.sum()]


def fit_weights(chosen: list[str], docs: list[tuple[int, list[int], list[int]]], toxic: np.ndarray, fitted: np.ndarray, prior: float) -> ToxicityModel:
    """Noisy-or model of document labels over known_features(); prior: share of toxic documents to place the threshold for."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any() or not fitted.any():
        return ToxicityModel()
    n_sent = np.array([d[0] for d in docs], np.int64)
    doc_of = np.repeat(np.arange(len(docs)), n_sent)
    base = np.cumsum(n_sent) - n_sent
    sent_of = np.concatenate([np.asarray(d[1], np.int64) + k for d, k in zip(docs, base)])
    feat = np.concatenate([np.asarray(d[2], np.int64) for d in docs])
    w, b = np.zeros(len(chosen)), -4.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(w, b, sent_of, feat, doc_of, toxic, fitted)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model = ToxicityModel({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-4}, float(b))
    z = b + np.bincount(sent_of, w[feat], minlength=len(doc_of)) if len(feat) else np.full(len(doc_of), b)
    by_doc = np.split(z, np.searchsorted(doc_of, np.arange(1, len(docs))))
    score = np.array([model.logit(x) for x in by_doc])
    # the threshold with the best F1 among calibration documents weighted to the prior, at the middle of a gap
    cal = ~fitted if (~fitted & toxic).any() and (~fitted & ~toxic).any() else fitted
    s, y = score[cal], toxic[cal]
    weight = np.where(y, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    order = np.argsort(-s, kind="stable")
    s, y, weight = s[order], y[order], weight[order]
    hit, miss = np.cumsum(weight * y), np.cumsum(weight * ~y)
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    k = int(np.argmax(f1))
    model.cut = float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row's CRC32 of its id as text, mod 3, is 1, the part that isn't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Model of the labels (id_col, label_col) from a bounded sample of them."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return ToxicityModel()
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.when(F.col("y") == 1, F.lit(SAMPLE_TOXIC / sizes[1])).otherwise(F.lit(SAMPLE_OTHER / sizes[0]))
    sample = known.filter(draw < share)  # about SAMPLE_TOXIC + SAMPLE_OTHER rows at most, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(sample), "doc_id")
    texts = cut(texts.withColumn("fitted", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5)) != 4))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                found[y].update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
        for y, c in found.items():
            names, counts = list(c), list(c.values())
            for k in range(0, len(names), 20_000):
                yield pd.DataFrame({"feature": names[k : k + 20_000], "y": y, "n": counts[k : k + 20_000]})

    per = texts.filter("fitted").select("text", "y").mapInPandas(count, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    totals = {r["y"]: r["count"] for r in texts.filter("fitted").groupBy("y").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    ratio = (F.col("pos") / max(1, n_pos)) / ((F.col("neg") + 1) / F.lit(n_neg + 1))
    strong = per.filter((F.col("pos") >= MIN_DOCS) & (ratio >= MIN_RATIO)).toPandas()  # features of the sample
    chosen = choose_features(dict(zip(strong["feature"], strong["pos"])), dict(zip(strong["feature"], strong["neg"])), n_pos, n_neg)
    index = {f: k for k, f in enumerate(chosen)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [known_features(t, index) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "fitted": pdf["fitted"], "n": [m[0] for m in made], "sent": [m[1] for m in made], "feat": [m[2] for m in made]})

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "y", "fitted", "text").mapInPandas(place, f"doc_id {kind}, y int, fitted boolean, n int, sent array<int>, feat array<int>").toPandas()
    rows = rows.sort_values(["doc_id", "n"], kind="stable").drop_duplicates("doc_id")
    return fit_weights(chosen, list(zip(rows["n"], rows["sent"], rows["feat"])), rows["y"].to_numpy() == 1, rows["fitted"].to_numpy(bool), sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and offending (spans and probabilities of sentences of at least 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(1):
                found = m.sentences(t.as_py() or "")
                scores.append(m.score(np.array([z for _, _, z in found])))
                spans.append([{"start": a, "end": b, "p": 1 / (1 + np.exp(-z))} for a, b, z in found if z >= 0])
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "score", "predicted", "offending"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted and offending of every row of docs; held-out labels aren't learned from."""
    model = fit(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "offending")
