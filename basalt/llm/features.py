"""Hashed word and character n-gram features of whole texts, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrays import _TABLE, Words, hash_strings, inside, mix, rolling


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + sizes[i] - 1 for each i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def subwords(vocabulary: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bucket): per word its own bucket, then those of its character n-grams (bytes, < and > at the ends)."""
    own = (hash_strings(vocabulary) % np.uint64(buckets)).astype(np.int64)
    mark = lambda x: pa.scalar(x, pa.large_string())
    marked = pc.binary_join_element_wise(mark("<"), vocabulary.cast(pa.large_string()), mark(">"), mark("")).cast(pa.large_binary())
    _, offsets, data = marked.buffers()
    starts = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1].copy()
    raw = _TABLE[np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]] if len(marked) else np.zeros(0, np.uint64)
    starts -= starts[0] if len(starts) else 0
    word = np.repeat(np.arange(len(marked)), np.diff(starts))
    grams, owner = [own], [np.arange(len(own))]
    for n in range(low, high + 1):
        at = inside(starts, n)
        grams.append((mix(rolling(raw, n)[at] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64) if len(at) else np.zeros(0, np.int64))
        owner.append(word[at])
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(own)))]), grams[order]


def pairs(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each pair of neighbouring words; a word that repeats its neighbour gives one bucket for all."""
    at = inside(words.starts, 2)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()
    bucket = (mix(rolling(h, 2)[at] + np.uint64(2)) % np.uint64(buckets)).astype(np.int64)
    bucket[words.code[at] == words.code[at + 1]] = 0
    return words.doc()[at], bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, per_class: int) -> tuple[list, dict]:
    """Up to per_class texts of each label, those of least hashed doc_id, and the labels' counts among training rows.

    trains: over the labels' columns, which rows may be learned from.  Rows without doc_id or label are passed over; a
    doc_id that repeats counts once, with its first row in the order of hash and text.
    """
    given = labels.where(trains & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ranked = given.withColumn("r", F.xxhash64("doc_id"))
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(counts):
        part = ranked.where(F.col("y") == y).orderBy("r", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    if picked is None:
        return [], counts
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # broadcast: at most per_class rows a label
    rows = texts.groupBy("doc_id", "r", "y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["r", "doc_id"])
    return list(zip(rows["text"], rows["y"], rows["doc_id"], strict=True)), counts


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
