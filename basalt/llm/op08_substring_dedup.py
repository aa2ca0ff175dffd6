"""Substring deduplication with prefix-partitioned suffix trees.

A word is removed if a window of ``window`` words covers it whose sequence also starts in a document with a smaller
doc_id.  Suffixes are word suffixes, and trees reach down to the window's depth, below which every leaf pair repeats.

1. Documents are packed into batches, written once (see shared.packed).
2. Candidates: each window picks the least hash of its ``gram``-word grams (equal windows pick equal ones).  A batch
   sends its distinct picks to buckets by hash; a bucket answers one bit a pick: does it occur in two documents?  Only
   suffixes at such picks can repeat, the rest is left out of the trees.
3. Prefixes: the candidate suffixes of all batches, which begin at picks, are counted by the hashes of their first 1, 2
   .. ``gram`` - 1 words, in SLOTS slots a length.  Prefixes in a slot that more than ``group`` suffixes have are split by
   their next word, so prefixes are of variable length and each holds a group that fits into memory, up to the gram itself.
4. Trees: a batch sends its distinct candidate stretches (a pick's windows, as words) with the least and greatest
   doc_id holding them, dealt by the suffix's prefix: equal windows have equal picks and so one prefix.  A task sorts
   its group's suffixes, in parts by further words where they are many, and the common prefixes of neighbours give the
   inner nodes of each part's tree.  The deep nodes, at the window's depth, are the repeats, and each answers its
   least doc_id.
5. Each batch marks its windows with a smaller doc_id than its own; overlapping ones join into maximal stretches.

A group holds at most one row a batch for each sequence, however many documents share it, so a passage that a third
of all documents hold costs a task no more than one of a few.  Words are compared as words, not as hashes, in the trees.

Rows: one per row of documents.  Null, empty or blank text: no words, nothing removed.  Texts shorter than the window
lose nothing.  Rows that share a doc_id do not remove from each other.  A null doc_id counts as the greatest of all.
Empty table: no rows.  Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import ranges
from .shared import from_bytes, packed, table, tidied, to_bytes, written
from .text_arrays import _R, Words, inside, mix, rolling

LAST = 2**63 - 1
#: Prefixes are counted, and split, by so many slots of their hashes a length; groups grow with the input beyond it.
SLOTS = 1 << 14
#: Packed bytes of input a bucket.
BUCKET_BYTES = 8 << 20


def slot(key: np.ndarray) -> np.ndarray:
    """The slot of a prefix, of its hash's upper bits."""
    return ((key >> np.uint64(32)) % np.uint64(SLOTS)).astype(np.int64)


class Stretches:
    """Runs of a batch's windows that pick the same gram."""

    def __init__(self, batch: pa.Table, window: int, gram: int, buckets: int):
        self.window, self.gram = window, gram
        self.words = words = Words(batch.column("text"), lower=False)
        ids = batch.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(LAST)
        self.ids = ids.to_numpy()
        h = words.hashes()
        at = inside(words.starts, window)
        self.whole = rolling(h, window)
        least = rolling(h, gram)
        picks = np.arange(len(least))
        size, goal = 1, window - gram + 1
        values = least
        while size < goal:
            shift = min(size, goal - size)
            left = values[:-shift] <= values[shift:]
            values, picks = np.where(left, values[:-shift], values[shift:]), np.where(left, picks[:-shift], picks[shift:])
            size += shift
        mine = picks[at] if len(at) else np.zeros(0, np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        self.first = at[firsts]
        self.at = mine[firsts]
        self.h = h
        self.n = np.diff(np.concatenate([firsts, [len(mine)]]))
        self.pick = least[mine[firsts]] if len(mine) else np.zeros(0, np.uint64)
        self.doc = words.doc()[self.first] if len(mine) else np.zeros(0, np.int64)
        self.bucket = (self.pick >> np.uint64(20)) % np.uint64(buckets)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct picks in the order of bucket and hash: (bucket, pick, in two documents, index of each stretch)."""
        order = np.lexsort((self.pick, self.bucket))
        pick = self.pick[order]
        new = np.concatenate([[True], pick[1:] != pick[:-1]]) if len(pick) else np.zeros(0, bool)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        cut = np.flatnonzero(new)
        ids = self.ids[self.doc[order]]
        two = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut) if len(cut) else np.zeros(0, bool)
        return self.bucket[order][new], pick[new], two, back

    def prefixes(self, use: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first words of the suffixes that begin at the picks of the stretches use."""
        out = np.zeros(len(use), np.uint64)
        for j in range(length):
            out = out * _R + self.h[self.at[use] + j]
        return mix(out)

    def slots(self, use: np.ndarray) -> np.ndarray:
        """(length, slot) -> how many of the stretches use begin with a prefix of that many words, less than a gram, in that slot."""
        out = np.zeros((self.gram - 1, SLOTS), np.int64)
        for length in range(1, self.gram):
            out[length - 1] = np.bincount(slot(self.prefixes(use, length)), minlength=SLOTS)
        return out

    def deal(self, use: np.ndarray, splits: list[np.ndarray], buckets: int) -> None:
        """Puts the stretches use into the buckets of their prefixes: the shortest ones whose slots are not split."""
        self.bucket = np.zeros(len(self.first), np.uint64)
        open_ = np.arange(len(use))
        for length in range(1, len(splits) + 2):
            key = self.prefixes(use[open_], length)
            split = np.isin(slot(key), splits[length - 1]) if length <= len(splits) else np.zeros(len(open_), bool)
            self.bucket[use[open_[~split]]] = mix(key[~split] + np.uint64(length)) % np.uint64(buckets)
            open_ = open_[split]

    def distinct(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches use: distinct ones by bucket (a sample each, least and greatest doc_id, index of each of use)."""
        first, n = self.first[use], self.n[use]
        order = np.lexsort((n, self.whole[first + n - 1], self.whole[first], self.bucket[use]))
        key = np.stack([self.bucket[use], self.whole[first], self.whole[first + n - 1], n.astype(np.uint64)])[:, order]
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, bool)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        cut = np.flatnonzero(new)
        ids = self.ids[self.doc[use][order]]
        low = np.minimum.reduceat(ids, cut) if len(cut) else ids
        high = np.maximum.reduceat(ids, cut) if len(cut) else ids
        return use[order][new], low, high, back


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run in a sorted array."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True)) if len(cut) else []


def repeated_picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's answer: a bit for each pick of each batch, whether two documents hold it."""
    rows = [(n, b, np.frombuffer(p, np.uint64), np.frombuffer(t, bool)) for batch in batches for n, b, p, t in zip(*(batch.column(c).to_pylist() for c in ("batch", "bucket", "picks", "two")), strict=True)]
    _, back, times = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
    many = times > 1
    many[back[np.concatenate([r[3] for r in rows])]] = True
    bits, start = many[back], 0
    for n, b, p, _ in rows:
        yield pa.RecordBatch.from_pydict({"batch": [n], "bucket": [b], "answer": [np.packbits(bits[start : start + len(p)]).tobytes()]}, schema=ANSWER)
        start += len(p)


ANSWER = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def prefix_groups(word: np.ndarray, start: np.ndarray, depth: int, group: int) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes (indices into start) by prefixes of variable length, so that a group has at most ``group`` of them.

    Yields (suffixes, length of the common prefix); suffixes alone with their prefix are left out.  A group of that
    many equal windows is no longer divisible and comes whole, at full depth.
    """
    todo = [(np.arange(len(start)), 0)]
    while todo:
        some, deep = todo.pop()
        if len(some) < 2:
            continue
        if len(some) <= group or deep == depth:
            yield some, deep
            continue
        keys = word[start[some] + deep]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        small: list[np.ndarray] = []
        room = 0
        for _, a, b in slices(keys):
            part = some[order[a:b]]
            if len(part) > group:
                todo.append((part, deep + 1))
            elif len(part) > 1:
                if room + len(part) > group:  # neighbours that fit share a group, as their first word tells them apart
                    todo.append((np.concatenate(small), deep))
                    small, room = [], 0
                small.append(part)
                room += len(part)
        if small:
            todo.append((np.concatenate(small), deep))


def sorted_suffixes(word: np.ndarray, start: np.ndarray, some: np.ndarray, deep: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words that each shares with the one before it) down to the depth; the first ``deep`` are common.

    Suffixes that are alone with their next words are left out as the sort goes down, as no inner node is above them
    alone.
    """
    rank = np.zeros(len(some), np.int64)
    columns = []
    for level in range(deep, depth):
        _, label = np.unique(word[start[some] + level], return_inverse=True)
        _, rank, leaves = np.unique(rank * (label.max(initial=0) + 1) + label, return_inverse=True, return_counts=True)
        alive = leaves[rank] > 1
        columns = [c[alive] for c in (*columns, label)]
        some, rank = some[alive], rank[alive]
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
        shared[1:] += same
    shared[1:] += deep
    return some[order], shared


def inner_nodes(shared: np.ndarray, least: int) -> np.ndarray:
    """(depth, first leaf, past leaf) of the tree's inner nodes of at least that depth, from neighbours' common prefixes.

    A node is a longest run of leaves whose neighbours share its depth or more, and two of which no more.
    """
    found = []
    for d in np.unique(shared[shared >= least]).tolist():
        inside = np.concatenate([shared[1:] >= d, [False]])
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        past = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]])) + 1
        if len(first):
            lowest = np.minimum.reduceat(np.concatenate([shared, [0]]), np.stack([first + 1, past], 1).ravel())[::2]
            found.append(np.stack([np.full(len(first), d), first, past], 1)[lowest == d])
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def tree_answers(window: int, group: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(n, b, from_bytes(s), from_bytes(v)) for batch in batches for n, b, s, v in zip(*(batch.column(c).to_pylist() for c in ("batch", "bucket", "stretches", "vocabulary")), strict=True)]
        # one numbering of the words of all batches
        coded = pa.chunked_array([v.column(0).combine_chunks() for _, _, _, v in rows]).combine_chunks().dictionary_encode().indices.to_numpy()
        codes, starts, ends, low, high, base, at = [], [], [], [], [], 0, 0
        for _, _, s, v in rows:
            local = coded[at : at + v.num_rows]
            at += v.num_rows
            lists = s.column("words").combine_chunks()
            cuts = lists.offsets.to_numpy().astype(np.int64)
            codes.append(local[lists.values.to_numpy()])
            starts.append(cuts[:-1] + base)
            ends.append(np.diff(cuts))
            base += int(cuts[-1])
            low.append(s.column("low").to_numpy())
            high.append(s.column("high").to_numpy())
        word, first, n = np.concatenate(codes), np.concatenate(starts), np.concatenate(ends) - window + 1
        suffix = ranges(first, n)
        low, high = np.repeat(np.concatenate(low), n), np.repeat(np.concatenate(high), n)
        answer = np.where(low != high, low, LAST)
        for some, deep in prefix_groups(word, suffix, window, group):
            some, shared = sorted_suffixes(word, suffix, some, deep, window)
            nodes = inner_nodes(shared, window)
            if len(nodes):
                _, first, past = nodes.T
                leaves = ranges(first, past - first)
                least = np.minimum.reduceat(low[some[leaves]], np.cumsum(past - first) - (past - first))
                answer[some[leaves]] = np.repeat(least, past - first)
        sizes = [int((np.diff(s.column("words").combine_chunks().offsets.to_numpy()) - window + 1).sum()) for _, _, s, _ in rows]
        start = 0
        for (b, bucket, _, _), size in zip(rows, sizes, strict=True):
            yield pa.RecordBatch.from_pydict({"batch": [b], "bucket": [bucket], "answer": [to_bytes(pa.table({"least": answer[start : start + size]}))]}, schema=ANSWER)
            start += size

    return work


def answered(batches: DataFrame, *answers: DataFrame) -> DataFrame:
    """(batch, payload, answers_0, ...): each batch with what its buckets answered, in their order."""
    for i, a in enumerate(answers):
        mine = a.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("x")).select(F.col("batch").alias("b"), F.col("x.answer").alias(f"answers_{i}"))
        batches = batches.join(mine, F.col("batch") == F.col("b"), "left").drop("b")
    return batches


def bits_of(column: pa.Array, bucket: np.ndarray) -> np.ndarray:
    parts = column.as_py() or []
    return np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=b - a) for p, (_, a, b) in zip(parts, slices(bucket), strict=True)]).astype(bool) if parts else np.zeros(0, bool)


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 7, group: int = 200_000, sample: int = 64, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """(doc_id, *keep, text, n_words, n_removed, removed): text as the kept words, joined by one space; removed as

    the maximal stretches struct(first, past) of word positions.  keep: further columns of docs to hand on.
    untouched: a text of which no word is removed stays as it is, white space included (null: empty).
    sample: without effect, as all batches are counted.
    """
    names = [c for c in keep if c not in ("doc_id", "text")]
    batches = packed(docs, {"doc_id": "doc_id", "text": "text"} | {f"k{i}": c for i, c in enumerate(names)})
    total, n_batches = batches.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(32, -(-total // BUCKET_BYTES))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for n, payload in zip(r.column("batch").to_pylist(), r.column("payload"), strict=True):
                bucket, pick, two, _ = Stretches(from_bytes(payload.as_py()), window, gram, buckets).asked()
                cuts = slices(bucket)
                yield pa.RecordBatch.from_pydict({"batch": [n] * len(cuts), "bucket": [c[0] for c in cuts], "picks": [pick[a:b].tobytes() for _, a, b in cuts], "two": [two[a:b].tobytes() for _, a, b in cuts]}, schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("picks", pa.binary()), ("two", pa.binary())]))

    def per_table(work):
        def group(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(tidied(work)(iter(t.to_batches()))), schema=ANSWER)

        return group

    shape = "batch long, bucket long, answer binary"
    asks = batches.mapInArrow(tidied(ask), "batch long, bucket long, picks binary, two binary")
    picks = written(asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(per_table(repeated_picks), shape), "pick-answers")

    def candidates(t: pa.Table, answer: pa.Scalar) -> tuple[Stretches, np.ndarray]:
        s = Stretches(t, window, gram, buckets)
        bucket, _, _, back = s.asked()
        bits = bits_of(answer, bucket)
        return s, (np.flatnonzero(bits[back]) if len(back) else np.zeros(0, np.int64))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((gram - 1, SLOTS), np.int64)
        for r in rows:
            for i in range(r.num_rows):
                s, use = candidates(from_bytes(r.column("payload")[i].as_py()), r.column("answers_0")[i])
                total += s.slots(use)
        length, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"length": (length + 1).astype(np.int32), "slot": at, "n": total[length, at]})

    counts = written(answered(batches, picks).mapInArrow(tidied(count), "length int, slot long, n long").groupBy("length", "slot").agg(F.sum("n").alias("n")), "prefix-counts")
    most = max(group, (counts.where("length = 1").agg(F.sum("n")).first()[0] or 0) // SLOTS)
    frequent = counts.where(F.col("n") > most).select("length", "slot").collect()  # at most SLOTS a length
    splits = [np.array(sorted(r["slot"] for r in frequent if r["length"] == length), np.int64) for length in range(1, gram)]

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("stretches", pa.binary()), ("vocabulary", pa.binary())])
        for r in rows:
            for i, n in enumerate(r.column("batch").to_pylist()):
                s, use = candidates(from_bytes(r.column("payload")[i].as_py()), r.column("answers_0")[i])
                s.deal(use, splits, buckets)
                sample, low, high, _ = s.distinct(use)
                for b, a, e in slices(s.bucket[sample]):
                    size = s.n[sample[a:e]] + window - 1
                    used, local = np.unique(s.words.code[ranges(s.first[sample[a:e]], size)], return_inverse=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(local, pa.int32()))
                    rows_ = pa.table({"words": lists, "low": low[a:e], "high": high[a:e]})
                    words = pa.table({"w": s.words.vocabulary.take(pa.array(used))})
                    yield pa.RecordBatch.from_pydict({"batch": [n], "bucket": [b], "stretches": [to_bytes(rows_.combine_chunks())], "vocabulary": [to_bytes(words)]}, schema=schema)

    sent = answered(batches, picks).mapInArrow(tidied(send), "batch long, bucket long, stretches binary, vocabulary binary")
    trees = written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(per_table(tree_answers(window, group)), shape), "tree-answers")

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for i in range(r.num_rows):
                t = from_bytes(r.column("payload")[i].as_py())
                s, use = candidates(t, r.column("answers_0")[i])
                gone = np.zeros(len(s.words.code), bool)
                if len(use):
                    s.deal(use, splits, buckets)
                    sample, _, _, back = s.distinct(use)
                    least = np.concatenate([from_bytes(p).column(0).to_numpy() for p in r.column("answers_1")[i].as_py()])
                    offsets = np.concatenate([[0], np.cumsum(s.n[sample])])
                    n = s.n[use]
                    mine = least[ranges(offsets[back], n)] < np.repeat(s.ids[s.doc[use]], n)
                    starts = ranges(s.first[use], n)[mine]
                    edge = np.zeros(len(gone) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                yield results(t, s.words, gone, names, untouched)

    fields = [docs.schema["doc_id"], *[docs.schema[c] for c in names]]
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    span = ArrayType(StructType([StructField("first", IntegerType()), StructField("past", IntegerType())]))
    schema = StructType([*fields, StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("removed", span)])
    return answered(batches, picks, trees).mapInArrow(tidied(finish), schema)


def results(t: pa.Table, words: Words, gone: np.ndarray, names: list[str], untouched: bool) -> pa.RecordBatch:
    starts = words.starts
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[starts])
    kept = pa.ListArray.from_arrays(pa.array(starts - np.concatenate([[0], np.cumsum(gone)])[starts], pa.int32()), words.vocabulary.take(pa.array(words.code[~gone])).cast(pa.string()))
    texts = pa.compute.binary_join(kept, " ")
    spans = []
    for d in range(len(starts) - 1):
        x = np.diff(np.concatenate([[0], gone[starts[d] : starts[d + 1]].astype(np.int8), [0]])) if removed[d] else np.zeros(0)
        spans.append([{"first": a, "past": b} for a, b in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)])
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in texts.to_pylist()]
    if untouched:
        texts = pa.compute.if_else(pa.array(removed > 0), texts, pa.compute.fill_null(t.column("text"), "").cast(pa.string()))
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    columns = {"doc_id": t.column("doc_id")} | {c: t.column(f"k{i}") for i, c in enumerate(names)} | {"text": texts, "n_words": pa.array(np.diff(starts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": shas, "removed": pa.array(spans, span)}
    return pa.table(columns).combine_chunks().to_batches()[0]


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _oracle(window: int = 13) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT id, doc_id, i, array_to_string(w[i:i+{window - 1}], ' ') AS g FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
m AS (SELECT id, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM s),
r AS (SELECT DISTINCT id, unnest(range(i, i + {window})) AS p FROM m WHERE least < doc_id),
w AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT w.id, count(r.p) AS gone, string_agg(CASE WHEN r.p IS NULL THEN w.w END, ' ' ORDER BY w.p) AS t FROM w LEFT JOIN r ON w.id = r.id AND w.p = r.p GROUP BY w.id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.id = k.id"""


ORACLE = _oracle()
