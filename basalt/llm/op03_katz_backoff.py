"""Language-model scores: Katz backoff of any order, with Good-Turing discounts and exact backoff weights.

Tokens: the words of a text, then one end.  A start stands before the first word and is context only, so the first
tokens of a text have shorter contexts.  Outcomes are the V distinct training tokens and one class for all others.
With counts c, a context h of k - 1 tokens, h' the same without its first, and per order Good-Turing factors d,

    p(w)     = d c(w) / N for seen w; the class of unseen words gets the rest;
    p(w | h) = d c(h w) / c(h) if c(h w) >= 1, else a(h) p(w | h');
    a(h)     = (1 - sum of p(w | h) over the w seen after h) / (1 - sum of p(w | h') over them), 1 for an unseen h.

So every context's probabilities sum to one.  A context whose n-grams would leave nothing for the rest counts one
occurrence more.  Counts of one are kept.  If an order's counts of counts give no valid factors, their log-linear fit
is used, and failing that half an occurrence is discounted.

The recursion is evaluated per token from order 1 upwards: an order adds log a(h) to what the recursion has so far, or,
where h w is seen, what replaces it by log p(w | h).  As the suffix of a seen n-gram is seen too, that is the difference
log p(w | h) - log p(w | h'), a number of the n-gram's own; so one lookup an order and token answers either.

Tables: texts are hashed in chunks.  A chunk sends its distinct n-grams with counts to buckets by context; n-grams of a
context with a share of 1/HOT_CONTEXTS of the tokens or more (at most so many) are spread over all buckets, and their
sums are added up apart.  A bucket's n-grams are one packed row of the model, a table partitioned by kind and order.
Scoring: a chunk sends its n-grams to the same buckets with the documents that hold them; a bucket answers sums for
these documents, which are added up by chunk.  N-grams with a share of 1/HOT of the tokens or more (at most HOT an
order) are looked up in the chunk itself, so no bucket meets a hot key.  Words that are among the most frequent ones,
CODES at most, travel as 16-bit codes, all others as 64-bit hashes, by which tokens and contexts are told apart.

Rows: one per row of documents.  Null or empty text: the end alone.  A null doc_id is scored, and learned from (no
remainder holds it out).  Rows that repeat are learned from and scored each.  Without training rows the class of unseen
words has probability one.  Empty table: no rows.  Texts of any length are taken whole.  Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import remainder
from .shared import chunks, dropped, from_bytes, table, tidy, to_bytes, written
from .text_arrays import Words, mix

END = np.uint64(0x454E44000000454E)
CODES, HOT, HOT_CONTEXTS = 65_535, 65_536, 16_384
#: The start's code; no word has it.
START = np.uint64(CODES)
#: Bytes of text a chunk, and a bucket: the latter up to LARGE where there would be over MANY buckets.
CHUNK, BUCKET, LARGE, MANY = 5 << 20, 16 << 20, 256 << 20, 4096
TOP = 5
_R = np.uint64(0x9E3779B97F4A7C15)


def blob(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def unblob(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(data))  # only ever what blob() wrote


def short(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids as a bit each, 16-bit codes and 64-bit hashes."""
    coded = ids <= START
    return np.packbits(coded), ids[coded].astype(np.uint16), ids[~coded]


def long(bits: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n = len(codes) + len(hashes)
    coded = np.unpackbits(bits, count=n).astype(bool)
    out = np.empty(n, np.uint64)
    out[coded], out[~coded] = codes, hashes
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where neighbouring rows of the columns differ, the first row included."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def spans(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, past) of each run of a sorted array."""
    cut = runs_of(bucket)
    yield from zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)][: len(cut)], strict=True)


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context + _R) * _R + word)


def lookup(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, index) of keys in the sorted array known."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def picked(values: np.ndarray, at: np.ndarray, found: np.ndarray, other: float = 0.0) -> np.ndarray:
    return np.where(found, values[at], other) if len(values) else np.full(len(found), other)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of each document)."""
    words = Words(texts, lower=True)
    n = len(words.starts) - 1
    token = np.empty(len(words.code) + n, np.uint64)
    ends = words.starts[1:] + np.arange(n)  # where each document's end stands
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[~is_end] = words.hashes()
    token[is_end] = END
    return np.where(token <= START, token + START + np.uint64(1), token), words.counts + 1


class Vocabulary:
    """The most frequent words, by falling count: their number is their code."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]
        self.by_hash = np.argsort(hashes[order])
        self.hashes = hashes[order][self.by_hash]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        found, at = lookup(hashes, self.hashes)
        return np.where(found, picked(self.by_hash, at, found).astype(np.uint64), hashes)


class Sequence:
    """The ids of a batch's texts, each after a start."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        hashes, sizes = hashed(texts)
        n = len(sizes)
        self.doc = np.repeat(np.arange(n), sizes + 1)
        firsts = np.cumsum(sizes + 1) - (sizes + 1)
        self.at = np.arange(len(self.doc)) - np.repeat(firsts, sizes + 1)
        self.ids = np.empty(len(self.doc), np.uint64)
        self.ids[self.at == 0], self.ids[self.at > 0] = START, vocabulary.ids(hashes)

    def context(self, size: int) -> np.ndarray:
        """Per position the id of the ``size`` tokens that end there (not meaningful where there are fewer)."""
        out = self.ids
        for _ in range(size - 1):
            out = extended(np.concatenate([out[:1], out[:-1]]), self.ids)
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, the context without its first token, token, document) of each n-gram; order 1 has empty contexts."""
        at = np.flatnonzero(self.at >= max(order - 1, 1))
        zero = np.zeros(len(at), np.uint64)
        context = self.context(order - 1)[at - 1] if order > 1 else zero
        below = self.context(order - 2)[at - 1] if order > 2 else zero
        return context, below, self.ids[at], self.doc[at]


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The id of a context and the token after it."""
    h = mix(context * _R + mix(word + _R))
    return np.where(h <= START, h + START + np.uint64(1), h)


class Dealer:
    """The bucket of each n-gram of an order: that of its context, or of its word and context if the context is hot."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot = buckets, hot

    def __call__(self, context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
        key = mix(word + _R) if order == 1 else np.where(self.is_hot(context), gram_key(context, word), mix(context + _R))
        return ((key >> np.uint64(17)) % np.uint64(self.buckets)).astype(np.int64)

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        return lookup(context, self.hot)[0]


PACKED = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def pack_grams(context: np.ndarray, below: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple:
    """Rows sorted by context, as runs."""
    lead = runs_of(context)
    return (*short(context[lead]), *short(below[lead]), small(lengths(lead, len(context))), *short(word), small(n))


def unpack_grams(parts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, below, runs) by context, (word, n) by n-gram."""
    return long(*parts[:3]), long(*parts[3:6]), parts[6].astype(np.int64), long(*parts[7:10]), parts[10].astype(np.int64)


def distinct(bucket: np.ndarray, context: np.ndarray, below: np.ndarray, word: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct n-grams in the order of bucket, context and word, with their counts."""
    order = np.lexsort((word, context, bucket))
    first = runs_of(bucket[order], context[order], word[order])
    counts = lengths(first, len(order)) if n is None else np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    order = order[first]
    return bucket[order], context[order], below[order], word[order], counts


MODEL = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary()), ("context", pa.int64()), ("word", pa.int64()), ("c", pa.int64()), ("s", pa.float64()), ("q", pa.float64())])
MODEL_DDL = "kind string, bucket long, payload binary, context long, word long, c long, s double, q double"


def model_rows(kind: str, bucket=(), payload=(), context=(), word=(), c=(), s=(), q=()) -> pa.Table:
    size = max(len(x) for x in (bucket, payload, context, c))
    columns = [[kind] * size, bucket, payload, context, word, c, s, q]
    signed = lambda x: x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x
    return pa.table([pa.array(signed(x), f.type) if len(x) else pa.nulls(size, f.type) for x, f in zip(columns, MODEL, strict=True)], schema=MODEL)


def histogram_bin(c: np.ndarray) -> np.ndarray:
    """An eighth of a power of two a bin: 512 at most."""
    return np.floor(np.log2(c) * 8).astype(np.int64)


def merge_counts(t: pa.Table) -> pa.Table:
    """A bucket's packed n-grams, and as rows of kind stat the counts of counts, totals and the counts' histogram."""
    rows = [unpack_grams(unblob(p)) for p in t.column("payload").to_pylist()]
    context = np.concatenate([np.repeat(r[0], r[2]) for r in rows])
    below = np.concatenate([np.repeat(r[1], r[2]) for r in rows])
    word, n = (np.concatenate([r[i] for r in rows]) for i in (3, 4))
    del rows
    _, context, below, word, c = distinct(np.zeros(len(word), np.int64), context, below, word, n)
    stats = {r: int((c == r).sum()) for r in range(1, TOP + 2)} | {8: int(c.sum()), 9: len(c)}
    if len(c):
        stats |= {100 + i: int(x) for i, x in enumerate(np.bincount(histogram_bin(c))) if x}
    body = blob(*pack_grams(context, below, word, c))
    return pa.concat_tables([model_rows("grams", [t.column("bucket")[0].as_py()], [body]), model_rows("stat", context=list(stats), c=list(stats.values()))])


def good_turing(seen: dict[int, int]) -> list[float]:
    """Katz's factors for counts 0 .. TOP + 1 (0 unused, above TOP: 1), from the counts of counts 1 .. TOP + 1.

    Where those give a factor outside 0 .. 1, their log-linear fit takes their place; after that half an occurrence.
    """
    def katz(n: list[float]) -> list[float] | None:
        rest = (TOP + 1) * n[TOP + 1] / n[1]
        if rest >= 1:
            return None
        d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, TOP + 1)] + [1.0]
        return d if all(0 < x < 1 for x in d[1 : TOP + 1]) else None

    raw = [0.0] + [float(seen.get(r, 0)) for r in range(1, TOP + 2)]
    if min(raw[1:]) > 0 and (d := katz(raw)):
        return d
    there = [r for r in range(1, TOP + 2) if raw[r] > 0]
    if len(there) >= 2:
        slope, height = np.polyfit(np.log(there), np.log([raw[r] for r in there]), 1)
        if d := katz([0.0] + [float(np.exp(height + slope * np.log(r))) for r in range(1, TOP + 2)]):
            return d
    return [1.0] + [(r - 0.5) / r for r in range(1, TOP + 1)] + [1.0]


def discounted(c: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return factors[np.minimum(c, TOP + 1)] * c


class Known:
    """A bucket's n-grams of one order, for lookups."""

    def __init__(self, order: int, payload: bytes | None, shared: Scores):
        self.shared, self.k = shared, order
        none = np.zeros(0, np.uint64)
        parts = unblob(payload) if payload else (*pack_grams(none, none, none, none), np.zeros(0))
        self.context, _, runs, word, self.c = unpack_grams(parts[:11])
        owner = np.repeat(np.arange(len(runs)), runs)
        key = gram_key(self.context[owner], word)
        self.at = np.argsort(key)
        self.key = key[self.at]
        s = discounted(self.c, shared.factors[order])
        if order == 1:
            self.log_p = np.log10(s / max(shared.n, 1))
            return
        low, starts = parts[11], np.cumsum(runs) - runs
        total, used, q = sums_of(self.c, s, 10.0**low, starts)
        hot, at = lookup(self.context, shared.hot[order])
        total = np.where(hot, picked(shared.hot_total[order], at, hot), total)
        self.log_p = np.log10(s / total[owner])
        self.gain = self.log_p - low
        with np.errstate(all="ignore"):  # a hot context's sums here are partial, and replaced
            self.log_a = np.where(hot, picked(shared.hot_log_a[order], at, hot), np.log10((1 - used / total) / (1 - q)))
        self.by_context = np.argsort(self.context)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, index) of n-grams."""
        found, at = lookup(gram_key(context, word), self.key)
        return found, self.at[at] if len(self.at) else at

    def step(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What the order adds to the recursion at each n-gram."""
        found, at = self.find(context, word)
        seen, where = lookup(context, self.context[self.by_context])
        out = picked(self.log_a[self.by_context], where, seen)
        hot, where = lookup(context, self.shared.hot[self.k])
        out = np.where(hot, picked(self.shared.hot_log_a[self.k], where, hot), out)
        return np.where(found, picked(self.gain, at, found), out)


def sums_of(c: np.ndarray, s: np.ndarray, q: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run: the total (one occurrence more where nothing is left for the rest), and the sums of s and q."""
    if not len(starts):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    total, used, low = (np.add.reduceat(x.astype(float), starts) for x in (c, s, q))
    return np.where(total - used < 1e-9 * total, total + 1, total), used, low


class Scores:
    """What all tasks need of the model: bounded numbers and arrays, whatever the corpus."""

    def __init__(self, buckets: int, order: int):
        self.buckets, self.order = buckets, order
        self.n, self.v, self.unseen = 0, 0, 1.0
        self.vocabulary = Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        none = np.zeros(0, np.uint64)
        self.factors: dict[int, np.ndarray] = {}
        #: by order: hot contexts, with their totals and log a, and hot n-grams as keys with what they add to the recursion
        self.hot = {1: none, 2: np.array([START])}
        self.hot_total: dict[int, np.ndarray] = {}
        self.hot_log_a: dict[int, np.ndarray] = {}
        self.top: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def dealer(self, order: int) -> Dealer:
        return Dealer(self.buckets, self.hot[order])

    def coded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a code of a word, its count, else 0)."""
        is_code = ids < START
        return is_code, picked(self.vocabulary.counts, np.where(is_code, ids, 0).astype(np.int64), is_code).astype(np.int64)


class Model:
    """The stored model: the tables of orders 1 .. order, and what all of them share."""

    def __init__(self, docs: DataFrame, trains, order: int = 3):
        """docs: doc_id, text.  trains: which rows are learned from."""
        texts = docs.where(trains).select("text")
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(32, min(-(-size // BUCKET), max(MANY, -(-size // LARGE))))
        self.shared = shared = Scores(buckets, order)
        self.tables: list[DataFrame] = []
        for k in range(1, order + 1):
            counts = written(self._sent(texts, k).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge_counts, MODEL_DDL), f"counts-{k}", ("kind",))
            stats = {r["context"]: r["c"] for r in counts.where("kind = 'stat'").groupBy("context").agg(F.sum("c").alias("c")).collect()}
            factors = good_turing({r: stats.get(r, 0) for r in range(1, TOP + 2)})
            shared.factors[k] = np.array(factors)
            if k == 1:
                shared.n, shared.v = stats.get(8, 0), stats.get(9, 0)
                shared.unseen = max(sum((1 - factors[r]) * r * stats.get(r, 0) for r in range(1, TOP + 1)) / shared.n, 1e-12) if shared.n else 1.0
                self.tables.append(counts.where("kind = 'grams'").select("bucket", "payload"))
                self._vocabulary(stats)
            else:
                self.tables.append(self._weighted(counts.where("kind = 'grams'").select("bucket", "payload"), k))
                dropped(counts)

    @property
    def n(self) -> int:
        return self.shared.n

    def _sent(self, texts: DataFrame, k: int) -> DataFrame:
        """(bucket, payload): the distinct n-grams of each chunk of texts with their counts."""
        shared, dealer = self.shared, self.shared.dealer(k)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text", CHUNK):
                if k == 1:
                    word = hashed(batch.column("text"))[0]
                    context = below = np.zeros(len(word), np.uint64)
                else:
                    context, below, word, _ = Sequence(batch.column("text"), shared.vocabulary).grams(k)
                bucket, context, below, word, n = distinct(dealer(context, word, k), context, below, word)
                yield packed_rows([(b, blob(*pack_grams(context[i:j], below[i:j], word[i:j], n[i:j]))) for b, i, j in spans(bucket)])
            tidy()

        return texts.mapInArrow(count, "bucket long, payload binary")

    def _vocabulary(self, stats: dict[int, int]) -> None:
        """The words that get codes: those above the least count that so many words at most reach."""
        shared = self.shared
        bins = sorted((k - 100 for k in stats if k >= 100), reverse=True)
        held, least = 0, None
        for b in bins:
            held += stats[100 + b]
            if held > CODES:
                break
            least = b
        if least is None:
            return

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.column("payload"):
                    _, _, _, word, c = unpack_grams(unblob(p.as_py()))
                    use = histogram_bin(c) >= least
                    yield pa.RecordBatch.from_arrays([pa.array(word[use].view(np.int64)), pa.array(c[use])], names=["word", "c"])

        got = self.tables[0].mapInArrow(frequent, "word long, c long").toArrow()  # at most CODES rows
        shared.vocabulary = Vocabulary(got.column("word").to_numpy().view(np.uint64), got.column("c").to_numpy())
        # a context is a word or the start; codes are in the order of counts
        often = int((shared.vocabulary.counts * HOT_CONTEXTS >= shared.n).sum())
        shared.hot[2] = np.append(np.arange(often), START).astype(np.uint64)

    def _weighted(self, grams: DataFrame, k: int) -> DataFrame:
        """(bucket, payload) with, for each n-gram, log p of its suffix; fills in what all tasks need of the order."""
        shared = self.shared
        below_dealer = shared.dealer(k - 1)

        def suffixes(payload: bytes) -> tuple:
            context, below, runs, word, c = unpack_grams(unblob(payload))
            owner = np.repeat(np.arange(len(runs)), runs)
            coded, n = shared.coded(word)
            need = np.flatnonzero(~coded) if k == 2 else np.arange(len(word))
            lower = below[owner][need]
            bucket = below_dealer(lower, word[need], k - 1)
            order = np.lexsort((word[need], lower, bucket))
            return context, below, runs, word, c, owner, n, need[order], bucket[order], lower[order]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for home, p in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                    _, _, _, word, _, _, _, need, bucket, lower = suffixes(p.as_py())
                    rows = [(home, b, blob(*short(lower[i:j]), *short(word[need[i:j]]))) for b, i, j in spans(bucket)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["home", "bucket", "payload"])
            tidy()

        def answer(asked: pa.Table, entries: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return REPLY.empty_table()
            known = Known(k - 1, entries.column("payload")[0].as_py(), shared)
            out = []
            for p in asked.column("payload").to_pylist():
                parts = unblob(p)
                context, word = long(*parts[:3]), long(*parts[3:])
                _, at = known.find(context, word)  # a suffix of a seen n-gram is seen
                out.append(blob(known.log_p[at]))
            return pa.table([asked.column("home"), asked.column("bucket"), pa.array(out, pa.binary())], schema=REPLY)

        asks = grams.mapInArrow(ask, "home long, bucket long, payload binary")
        even = lambda df: df.repartition(shared.buckets, "bucket").groupBy("bucket")
        replies = even(asks).cogroup(even(self.tables[k - 2])).applyInArrow(answer, "home long, target long, payload binary")
        gathered = replies.groupBy("home").agg(F.transform(F.sort_array(F.collect_list(F.struct("target", "payload"))), lambda x: x["payload"]).alias("low"))
        rows = grams.join(gathered, F.col("bucket") == F.col("home"), "left").select("bucket", "payload", "low")
        hot, factors, least = shared.hot[k], shared.factors[k], max(2, -(-shared.n // HOT))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, p, got in zip(batch.column("bucket").to_pylist(), batch.column("payload"), batch.column("low"), strict=True):
                    context, below, runs, word, c, owner, n, need, _, _ = suffixes(p.as_py())
                    low = np.empty(len(word))
                    if k == 2:
                        known = n > 0
                        low[known] = np.log10(discounted(n[known], shared.factors[1]) / shared.n)
                    low[need] = np.concatenate([unblob(x)[0] for x in got.as_py()]) if len(need) else 0
                    s = discounted(c, factors)
                    yield from model_rows("grams", [b], [blob(*pack_grams(context[owner], below[owner], word, c), low)]).to_batches()
                    starts = np.cumsum(runs) - runs
                    is_hot = lookup(context, hot)[0]
                    if is_hot.any():
                        total, used, q = (np.add.reduceat(x.astype(float), starts)[is_hot] for x in (c, s, 10.0**low))
                        yield from model_rows("hot", context=context[is_hot], c=total.astype(np.int64), s=used, q=q).to_batches()
                    top = np.flatnonzero(c >= least)
                    if len(top):  # bucket: the factor's denominator, where it is known here
                        total = np.where(is_hot, 0, sums_of(c, s, low, starts)[0]).astype(np.int64)
                        yield from model_rows("top", bucket=total[owner][top], context=context[owner][top], word=word[top], c=c[top], s=s[top], q=low[top]).to_batches()
            tidy()

        model = written(rows.mapInArrow(weigh, MODEL_DDL), f"katz-model-{k}", ("kind",))
        sums = model.where("kind = 'hot'").groupBy("context").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()  # at most HOT_CONTEXTS rows and the start
        key = sums.column("context").to_numpy().view(np.uint64)
        order = np.argsort(key)
        c, s, q = (sums.column(x).to_numpy()[order] for x in ("c", "s", "q"))
        total = np.where(c - s < 1e-9 * c, c + 1, c).astype(float)
        # contexts of the list that nothing follows in training are not seen, and looked up in no table
        shared.hot[k], shared.hot_total[k], shared.hot_log_a[k] = key[order], total, np.log10((1 - s / total) / (1 - q))
        self._top(model, k, least)
        return model.where("kind = 'grams'").select("bucket", "payload")

    def _top(self, model: DataFrame, k: int, least: int) -> None:
        """The hot n-grams of the order, and the hot contexts of the next."""
        shared = self.shared
        got = model.where("kind = 'top'").select("bucket", "context", "word", "c", "s", "q").toArrow()  # at most HOT rows
        context, word = (got.column(x).to_numpy().view(np.uint64) for x in ("context", "word"))
        total, c, s, low = (got.column(x).to_numpy() for x in ("bucket", "c", "s", "q"))
        hot, at = lookup(context, shared.hot[k])
        total = np.where(hot, picked(shared.hot_total[k], at, hot), total)
        key = gram_key(context, word)
        order = np.argsort(key)
        shared.top[k] = key[order], (np.log10(s / total) - low)[order]
        often = c * HOT_CONTEXTS >= shared.n
        shared.hot[k + 1] = np.unique(extended(context[often], word[often]))


REPLY = pa.schema([("home", pa.int64()), ("target", pa.int64()), ("payload", pa.binary())])
ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("home", pa.binary())])
ASK_DDL = "bucket long, chunk long, payload binary, home binary"


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs (doc_id, text)."""
    shared = model.shared
    rest, unseen = shared.n + 0.5 * (shared.v + 1), float(np.log10(shared.unseen))
    base_of = lambda c: np.log10((c + 0.5) / rest)

    def asked_of(seq: Sequence, k: int, sums: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(bucket, parts) of the n-grams that are looked up there; what is known here is added to sums."""
        size = sums.shape[1]
        context, below, word, doc = seq.grams(k)
        if k == 1:
            here, c = shared.coded(word)
            sums[1] += np.bincount(doc[here], minlength=size)
            sums[2] += np.bincount(doc[here], base_of(c[here]), size)
            gain = np.log10(discounted(c[here], shared.factors[1]) / max(shared.n, 1))
        else:
            here, at = lookup(gram_key(context, word), shared.top[k][0])
            gain = shared.top[k][1][at[here]] if here.any() else np.zeros(0)
        sums[3] += np.bincount(doc[here], gain, size)
        context, word, doc = context[~here], word[~here], doc[~here]
        bucket = shared.dealer(k)(context, word, k)
        order = np.lexsort((doc, word, context, bucket))
        bucket, context, word, doc = bucket[order], context[order], word[order], doc[order]
        first = runs_of(bucket, context, word, doc)
        times = lengths(first, len(doc))
        bucket, context, word, doc = bucket[first], context[first], word[first], doc[first]
        for b, i, j in spans(bucket):
            lead = runs_of(context[i:j], word[i:j])
            grams = context[i:j][lead], word[i:j][lead]
            yield b, (k, *pack_grams(grams[0], np.zeros_like(grams[0]), grams[1], lengths(lead, j - i)), small(doc[i:j]), small(times[i:j]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK):
            seq = Sequence(batch.column("text"), shared.vocabulary)
            sums = np.zeros((4, batch.num_rows))
            sums[0] = np.bincount(seq.doc, seq.at > 0, batch.num_rows)
            by_bucket: dict[int, list[tuple]] = {}
            for k in range(1, shared.order + 1):
                for b, parts in asked_of(seq, k, sums):
                    by_bucket.setdefault(b, []).append(parts)
            rows = [(b, chunk, blob(*parts), None) for b, parts in by_bucket.items()]
            rows.append((chunk % shared.buckets, chunk, None, blob(to_bytes(pa.table({"i": batch.column("doc_id")})), sums)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ASK, strict=True)], schema=ASK)
            chunk += 1
        tidy()

    def answer(asked: pa.Table, entries: pa.Table) -> pa.Table:
        payload = dict(zip(entries.column("n").to_pylist(), entries.column("payload").to_pylist(), strict=True))
        known = {k: Known(k, payload.get(k), shared) for k in range(1, shared.order + 1)} if asked.num_rows else {}
        out = []
        for bucket, chunk, parts, home in zip(*(asked.column(c).to_pylist() for c in ASK.names), strict=True):
            if parts is None:
                out.append((bucket, chunk, None, home))
                continue
            found_docs, found_sums = [], []
            for k, *part in unblob(parts):
                context, _, runs, word, n_docs = unpack_grams(tuple(part[:11]))
                context = np.repeat(context, runs)
                sums = np.zeros((3, len(word)))
                if k == 1:
                    found, at = known[1].find(context, word)
                    c = picked(known[1].c, at, found)
                    sums[0], sums[1], sums[2] = found, base_of(c), picked(known[1].log_p, at, found, unseen)
                else:
                    sums[2] = known[k].step(context, word)
                found_docs.append(part[11])
                found_sums.append(np.repeat(sums, n_docs, axis=1) * part[12])
            doc, index = np.unique(np.concatenate(found_docs), return_inverse=True)
            sums = np.concatenate(found_sums, axis=1)
            out.append((bucket, chunk, blob(doc, *[np.bincount(index, x, len(doc)) for x in sums]), None))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ASK, strict=True)], schema=ASK) if out else ASK.empty_table()

    def add(t: pa.Table) -> pa.Table:
        ids, sums = unblob(next(x for x in t.column("home").to_pylist() if x is not None))
        for p in t.column("payload").to_pylist():
            if p is not None:
                doc, *more = unblob(p)
                sums[1:, doc] += np.stack(more)
        whole = np.round(sums[:2]).astype(np.int64)
        return pa.table({"doc_id": from_bytes(ids).column("i"), "n_tokens": whole[0], "n_known": whole[1], "base_score": sums[2], "score": sums[3]})

    asks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ask, ASK_DDL)
    entries = None
    for k, t in enumerate(model.tables, 1):
        part = t.select(F.lit(k).alias("n"), "bucket", "payload")
        entries = part if entries is None else entries.unionByName(part)
    even = lambda df: df.repartition(shared.buckets, "bucket").groupBy("bucket")  # noqa: E731  as many tasks as buckets, whatever the session's setting
    answers = even(asks).cogroup(even(entries)).applyInArrow(answer, ASK_DDL)
    return answers.groupBy("chunk").applyInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


#: The order of the query's model; see the README for what a higher one takes.
ORDER = 2


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs, F.coalesce(remainder(5) != 1, F.lit(True)), ORDER)
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
