"""Quality classifier: supervised subword embeddings.

Hashed vectors of a text's words, of their character n-grams and of its word pairs are averaged over the whole text; a
softmax layer gives the classes' probabilities.  Vectors and layer are trained together by stochastic gradient descent
in numpy, on a bounded sample: at most ``per_class`` labelled texts of each class (those of least hashed doc_id), whole
texts each.  Classes are sampled evenly; the score is shifted back to the classes' shares among all training labels.
Scoring needs one number per bucket (the vector times the layer's difference), 2**bits floats sent to the executors.

Rows: one per row of documents.  Null or empty text: no features, so the score is the classes' prior.  A null doc_id
is scored, and neither held out nor learned from.  Labels without document, or null, are passed over; with fewer than
two classes the score is the share of label 1 (0.5 without labels).  Empty documents: no rows.  lang, source, doc_id
and further columns are no inputs.  Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import labelled_sample, pairs, ranges, remainder, subwords
from .shared import chunks, table, tidied
from .text_arrays import Words


@dataclass
class Model:
    value: np.ndarray  # per bucket: its vector's part in the log odds of class 1
    bias: float
    bits: int
    low: int
    high: int

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """Log odds of class 1 of each text."""
        words = Words(texts, lower=False)
        n = len(words.starts) - 1
        total, count = np.zeros(n), np.zeros(n)
        if len(words.code) and len(self.value):
            offsets, grams = subwords(words.vocabulary, self.low, self.high, 1 << self.bits)
            sums = np.add.reduceat(self.value[grams], offsets[:-1])
            doc = words.doc()
            total += np.bincount(doc, sums[words.code], n)
            count += np.bincount(doc, np.diff(offsets)[words.code], n)
            doc, bucket = pairs(words, 1 << self.bits)
            total += np.bincount(doc, self.value[bucket], n)
            count += np.bincount(doc, minlength=n)
        return total / np.maximum(count, 1) + self.bias


def document_features(texts: list[str], low: int, high: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares of all its features."""
    out = []
    for first in range(0, len(texts), 200):
        words = Words(pa.array(texts[first : first + 200], pa.string()), lower=False)
        offsets, grams = subwords(words.vocabulary, low, high, 1 << bits)
        docs, extra = pairs(words, 1 << bits)
        cut = np.searchsorted(docs, np.arange(len(words.starts)))
        sizes = np.diff(offsets)
        for d in range(len(words.starts) - 1):
            code = words.code[words.starts[d] : words.starts[d + 1]]
            bucket, n = np.unique(np.concatenate([grams[ranges(offsets[code], sizes[code])], extra[cut[d] : cut[d + 1]]]), return_counts=True)
            out.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(sample: list, counts: dict, bits: int = 17, low: int = 2, high: int = 4, dim: int = 8, epochs: int = 8, rate: float = 0.5, gain: float = 200.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over the sample.  gain: how much faster the vectors learn than the layer, as a

    text's mean spreads a step over hundreds of buckets.
    """
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len({y for _, y, _ in sample}) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.float32), float(np.log(p / (1 - p))), bits, low, high)
    rng = np.random.default_rng(seed)
    x = document_features([t for t, _, _ in sample], low, high, bits)
    y = np.array([v for _, v, _ in sample])
    vectors = rng.uniform(-1, 1, (1 << bits, dim)).astype(np.float32) / dim
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(x)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            bucket, part = x[i]
            now = rate * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            hidden = part @ vectors[bucket]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, hidden)
            bias -= now * p
            vectors[bucket] -= (now * gain) * part[:, None] * back
    sampled = np.bincount(y, minlength=2)
    shift = np.log(counts[1] / counts[0]) - np.log(sampled[1] / sampled[0])
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0] + shift), bits, low, high)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", trains: Column | None = None, per_class: int = 2000, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with a further column score, the probability of label 1.

    learn_from: where labelled texts are looked up, docs if not given.  A column score of docs is replaced.
    """
    sample, counts = labelled_sample(docs if learn_from is None else learn_from, labels, label, F.lit(True) if trains is None else trains, per_class)
    model = train(sample, counts)
    docs = docs.drop("score")
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            scores = 1 / (1 + np.exp(-model.log_odds(batch.column(batch.schema.get_field_index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidied(score), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = classify(docs, labels, "quality", remainder(4) != 2)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
