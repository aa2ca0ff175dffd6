"""Toxicity by classifier chains.

A chain predicts its categories one after the other.  Each link is a linear (logistic) model over the presence of
hashed word and character n-gram features, plus the probabilities of the categories before it.  While training, those
are out-of-fold predictions: a fold's rows get them from models fitted on the other folds, with features chosen on the
other folds, so that later links learn from inputs as good as the ones they will meet.  Features enter if they tell the
label's classes apart (present in ``least`` positive texts and at least ``lift`` times as often as among the negative
ones).

The labels table knows one toxicity label.  Further categories come before it in the chain: "severe" and "repeated" are
texts that hold at least four and two of the words found in toxic training texts only, where a fold's texts are judged
by the words of the other folds; "toxic", the last link, is the label, predicted from the features and the two
probabilities before it.

Trained on the driver on at most ``per_class`` labelled texts of each class, whole texts each; scored on all rows.
Rows: one per row of documents.  Null or empty text: no features, so the models' biases.  A null doc_id is scored, and
not learned from.  With fewer than two classes every probability is the share of label 1 (0 without labels).  Empty
documents: no rows.  lang, source, doc_id and further columns are no inputs.  Texts of any length are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import labelled_sample, ranges, remainder, subwords
from .shared import chunks, table, tidy
from .text_arrays import Words

#: In the chain's order: how many telling words make a category; 0 is the label itself.
CATEGORIES = {"severe": 4, "repeated": 2, "toxic": 0}


def present(texts: pa.Array, bits: int, low: int, high: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct feature of each text; with chosen only those, as indices into it."""
    words = Words(texts, lower=True)
    if not len(words.code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets, grams = subwords(words.vocabulary, low, high, 1 << bits)
    if chosen is not None:
        at = np.minimum(np.searchsorted(chosen, grams), max(len(chosen) - 1, 0))
        hit = chosen[at] == grams if len(chosen) else np.zeros(len(grams), bool)
        grams = at[hit]
        offsets = np.concatenate([[0], np.cumsum(hit)])[offsets]
    sizes = np.diff(offsets)
    some = sizes[words.code] > 0
    code, doc = words.code[some], words.doc()[some]
    key = np.unique(np.repeat(doc, sizes[code]) << bits | grams[ranges(offsets[code], sizes[code])])
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Link:
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, doc: np.ndarray, feature: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = len(before)
        z = np.bincount(doc, self.weights[feature], n) + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(doc: np.ndarray, feature: np.ndarray, before: np.ndarray, y: np.ndarray, use: np.ndarray, n_features: int, weight: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> Link:
    """Logistic regression by Adam on the rows use, all at once, with a weight each."""
    size = n_features + before.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    held = use[doc]
    d, f = doc[held], feature[held]
    weight = weight * use / max(1e-9, (weight * use).sum())
    n = max(1, use.sum())
    for t in range(1, steps + 1):
        link = Link(w[:n_features], w[n_features:-1], w[-1])
        error = (link.predict(d, f, before) - y) * weight
        grad = np.concatenate([np.bincount(f, error[d], n_features), before.T @ error, [error.sum()]]) + penalty * np.append(w[:-1], 0) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Link(w[:n_features], w[n_features:-1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    chosen: np.ndarray
    links: list[Link]
    bits: int
    low: int
    high: int
    share: float

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a column a category."""
        if not self.links:
            return np.full((len(texts), len(self.names)), self.share)
        doc, feature = present(texts, self.bits, self.low, self.high, self.chosen)
        before = np.zeros((len(texts), 0))
        for link in self.links:
            before = np.column_stack([before, link.predict(doc, feature, before)])
        return before


def derived(texts: list[str], y: np.ndarray, fold: np.ndarray, categories: dict[str, int], least: int = 3) -> np.ndarray:
    """A column a category: the label, or as many occurrences as it asks of telling words.

    A word is telling for a fold if at least ``least`` texts of label 1, and none of label 0, hold it in the other folds.
    """
    words = [Counter(t.lower().split()) for t in texts]
    toxic, clean = [[Counter() for _ in range(int(fold.max(initial=0)) + 1)] for _ in range(2)]
    for w, label, f in zip(words, y, fold, strict=True):
        (toxic if label else clean)[f].update(w.keys())
    all_toxic, all_clean = sum(toxic, Counter()), sum(clean, Counter())
    held = np.zeros(len(texts), np.int64)
    for f in range(len(toxic)):
        telling = {w for w, n in all_toxic.items() if n - toxic[f][w] >= least and all_clean[w] == clean[f][w]}
        for i in np.flatnonzero(fold == f):
            held[i] = sum(n for w, n in words[i].items() if w in telling)
    return np.column_stack([held >= need if need else y > 0 for need in categories.values()]).astype(float)


def present_in(texts: list[str], *how, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """present() of the texts, in chunks of about limit bytes."""
    first = 0
    for batch in chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), "text", limit):
        doc, feature = present(batch.column("text"), *how)
        yield doc + first, feature
        first += batch.num_rows


def train(sample: list, counts: dict, categories: dict[str, int] = CATEGORIES, bits: int = 20, low: int = 3, high: int = 6, least: int = 4, lift: float = 8.0, folds: int = 4) -> Chain:
    names = list(categories)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    empty = Chain(names, np.zeros(0, np.int64), [], bits, low, high, share)
    if len({y for _, y, _ in sample}) < 2:
        return empty
    texts, y = [t for t, _, _ in sample], np.array([v for _, v, _ in sample])
    fold = np.arange(len(texts)) % folds  # the sample's order is that of hashed doc_ids
    counted = np.zeros((2, folds, 1 << bits), np.int32)
    for doc, feature in present_in(texts, bits, low, high):
        np.add.at(counted, (y[doc], fold[doc], feature), 1)

    def choose(use: np.ndarray) -> np.ndarray:
        """The features that tell the classes apart in the folds use."""
        negative, positive = counted[:, use].sum(axis=1)
        size = [max(1, ((y == v) & np.isin(fold, use)).sum()) for v in (0, 1)]
        return np.flatnonzero((positive >= least) & (positive / size[1] >= lift * (negative + 0.5) / size[0]))

    every = [np.delete(np.arange(folds), k) for k in range(folds)] + [np.arange(folds)]
    chosen = [choose(use) for use in every]
    del counted
    # a second reading keeps features that some choice has; each model numbers its own
    union = np.unique(np.concatenate(chosen))
    doc, feature = (np.concatenate(x) for x in zip(*present_in(texts, bits, low, high, union), strict=True))
    rows = []
    for c in chosen:
        number = np.full(len(union), -1)
        number[np.searchsorted(union, c)] = np.arange(len(c))
        own = number[feature]
        rows.append((doc[own >= 0], own[own >= 0], len(c)))
    targets = derived(texts, y, fold, categories)
    drawn = np.bincount(y, minlength=2) / len(y)
    weight = np.where(y == 1, share / drawn[1], (1 - share) / drawn[0])  # back to the labels' shares
    everyone, before, links = np.ones(len(texts), bool), np.zeros((len(texts), 0)), []
    for j in range(len(names)):
        d, f, n = rows[folds]
        links.append(fit(d, f, before, targets[:, j], everyone, n, weight))
        out = np.zeros(len(texts))
        for k in range(folds if j + 1 < len(names) else 0):
            d, f, n = rows[k]
            out[fold == k] = fit(d, f, before, targets[:, j], fold != k, n, weight).predict(d, f, before)[fold == k]
        before = np.column_stack([before, out])
    return Chain(names, chosen[folds], links, bits, low, high, share)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", trains: Column | None = None, per_class: int = 2000, categories: dict[str, int] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category> of each category) of every row."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if trains is None else trains, per_class)
    chain = train(sample, counts, categories)
    del sample
    tidy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            p = chain.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, i]) for i in range(p.shape[1])]], names=["doc_id", *[f"p_{c}" for c in chain.names]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long" + "".join(f", p_{c} double" for c in categories))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity(docs, labels, "toxic", remainder(4) != 2)
    held = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"), "p_toxic", "p_repeated", "p_severe")
