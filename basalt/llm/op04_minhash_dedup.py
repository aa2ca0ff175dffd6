"""Near duplicates by MinHash with sequential Bayesian verification.

1. A document's set: its distinct k-word shingles (as 64-bit hashes), or its whole sequence if it has fewer words.
   Equal sets form one class (128-bit set hash), which goes on once, under a number of its own.
2. Signatures are cut in bands; the members of a band's bucket are candidates.  Rows a band are the most that miss a
   pair at the threshold with a probability of at most ``miss``.
3. Each member is compared with its bucket's smallest.  Signatures are compared batch by batch: with m of n hashes
   equal the similarity's posterior is Beta(m + 1, n - m + 1), and a pair is pruned once the probability of the
   threshold falls below ``miss``.  Survivors are verified on the full sets.
4. Links give components.  Only buckets whose members lie in several components can still hide a link; there all pairs
   of different components are compared, in blocks of bounded size.  Members are dealt by classes of their sets' size,
   as wide as the threshold, so that only blocks of one class or of neighbouring ones meet: each pair in the first
   band on which it agrees, by signature batches and then on the sets.  A pair of blocks answers with links that join
   components, at most one a member.  So each candidate pair is tested unless its ends are connected already, and no
   bucket is capped, and no list of its pairs is written.

Buckets that hold a share of 1/HOT of all band rows or more, so at most HOT of them, are joined by broadcast of what
is known of them: no task gets all rows of a hot bucket.

Rows: one per row of documents.  Null, empty or blank text: no shingles, never linked.  A null doc_id: never linked,
component_id null, kept.  Rows that share a doc_id are judged each by their own text: classes are told apart by their
sets, and a class's doc_id is only looked up for the answer.  Equal similarity to the threshold links.  Empty table:
no rows.  Texts of any length are taken whole.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import chunks, from_bytes, hot_join, hot_keys, table, tidied, to_bytes, written
from .text_arrays import Words, mix, shingles

BATCH = 24
#: Members, and bytes of their sets, a block aims at.
BLOCK, BLOCK_BYTES = 1024, 8 << 20


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1))
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def signature(values: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each permutation over distinct 64-bit shingles."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(flips), 2**32 - 1, np.uint32)
    for i in range(0, len(short), 2048):
        x = (short[i : i + 2048, None] ^ flips) * factors
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def bands_of(threshold: float, hashes: int, miss: float) -> int:
    """Rows a band: the most that lose a pair at the threshold with a probability of at most miss."""
    fit = [r for r in range(1, hashes + 1) if (1 - threshold**r) ** (hashes // r) <= miss]
    return max(fit, default=1)


def least_matches(threshold: float, hashes: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m equal ones leave the threshold a posterior probability under miss."""
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survive(left: np.ndarray, right: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the signature pairs that no batch prunes."""
    alive, equal, seen = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, m in least:
        equal = equal + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
        keep = equal >= m
        alive, equal, seen = alive[keep], equal[keep], n
    return alive


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, sorted."""
    words = Words(texts, lower=True)
    docs, values = shingles(words, k)
    cut = np.searchsorted(docs, np.arange(len(words.starts)))
    for i in range(len(words.starts) - 1):
        yield np.unique(values[cut[i] : cut[i + 1]])


def set_hash(values: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(values ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (0x1234567, 0x89ABCDEF01))


def signed(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, hi, lo, sig) of every row; text_key: xxhash64 of the text."""
    flips, factors = seeds(hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            sizes, his, los, sigs = [], [], [], []
            for values in sets_of(batch.column("text"), k):
                hi, lo = set_hash(values)
                sizes.append(len(values))
                his.append(hi)
                los.append(lo)
                sigs.append(signature(values, flips, factors).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "hi", "lo", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidied(work), "doc_id long, text_key long, n_shingles long, hi long, lo long, sig binary")


def _sigs(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), hashes)


def band_key(sig: np.ndarray, band: int, rows: int) -> np.ndarray:
    """The bucket of each signature in a band."""
    key = np.full(len(sig), band + 1, np.uint64)
    for j in range(band * rows, band * rows + rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
    return key.view(np.int64)


def banded(reps: DataFrame, hashes: int, rows: int) -> DataFrame:
    """(key, rep, size): a row for each band of each signature, with its set's size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sigs(batch.column("sig"), hashes)
            for band in range(hashes // rows):
                yield pa.RecordBatch.from_arrays([pa.array(band_key(sig, band, rows)), batch.column("rep"), batch.column("size")], names=["key", "rep", "size"])

    return reps.select("rep", "sig", F.col("n_shingles").alias("size")).mapInArrow(tidied(work), "key long, rep long, size long")


def plausible(pairs: DataFrame, reps: DataFrame, hashes: int, least: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that sequential Bayesian comparison of their signatures does not prune."""
    sig = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = survive(_sigs(batch.column("sig_a"), hashes), _sigs(batch.column("sig_b"), hashes), least)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidied(work), "a long, b long")


def full_sets_of(ends: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, members): the sorted shingles of each class of ends, as a written table.

    They are read from the texts of the class's doc_id whose set is the class's.
    """
    ends = ends.join(reps.select("rep", "doc", "hi", "lo"), "rep")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            held = [(i, v.tobytes()) for i, v in enumerate(sets_of(batch.column("text"), k)) if set_hash(v) == (batch.column("hi")[i].as_py(), batch.column("lo")[i].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array([i for i, _ in held], pa.int64())), pa.array([v for _, v in held], pa.binary())], names=["rep", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(ends, "doc")
    return written(texts.select("rep", "hi", "lo", "text").mapInArrow(tidied(full_sets), "rep long, members binary").dropDuplicates(["rep"]), "shingle-sets")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = full_sets_of(ends, reps, docs, k)
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("members").alias(f"set_{x}"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(tidied(linked), "a long, b long")


def packed_blocks(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, hot: list[int]) -> DataFrame:
    """(key, class, sub, payload): the members (key, rep, component, size) of each bucket in blocks of bounded size.

    class: the set's size on a logarithmic scale whose unit is the threshold, so that sets of classes further apart
    than one cannot reach it; sub: a part of a class of a bucket, by the class number's hash.
    """
    width = -log(percent / 100) * 1.000001 if percent < 100 else 1e-6  # a little more than a threshold's ratio
    dealt = members.withColumn("class", F.floor(F.log("size") / width))
    subs = dealt.groupBy("key", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("subs"))
    dealt = hot_join(dealt, written(subs, "block-counts"), ["key", "class"], hot)
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    dealt = dealt.join(reps.select("rep", "sig"), "rep").join(sets, "rep").select("key", "class", "sub", "component", "rep", "sig", "members")

    def pack(t: pa.Table) -> pa.Table:
        one = [t.column(c)[0].as_py() for c in ("key", "class", "sub")]
        body = to_bytes(t.select(["component", "rep", "sig", "members"]).combine_chunks())
        return pa.table({"key": [one[0]], "class": [one[1]], "sub": [one[2]], "payload": [body]}, schema=pa.schema([("key", pa.int64()), ("class", pa.int64()), ("sub", pa.int32()), ("payload", pa.binary())]))

    return written(dealt.groupBy("key", "class", "sub").applyInArrow(pack, "key long, class long, sub int, payload binary"), "blocks")


def meetings(blocks: DataFrame, hot: list[int]) -> DataFrame:
    """(key, c, i, d, j, payload): each block once for each pair of blocks (c, i), (d, j) of its bucket that it belongs to."""
    meta = blocks.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    near = meta.select("key", F.explode(F.array(*[F.struct((F.col("class") + x).alias("class"), F.lit(x).alias("x"), "n") for x in (-1, 0, 1)])).alias("m")).select("key", "m.class", "m.x", "m.n")
    # numbers of blocks of the class below (x = 1), of the own class, and of the one above
    count = lambda x: F.max(F.when(F.col("x") == x, F.col("n"))).alias(f"n{x + 1}")
    near = near.groupBy("key", "class").agg(count(-1), count(0), count(1)).where("n1 IS NOT NULL")
    rows = hot_join(blocks, near, ["key", "class"], hot)
    upto = lambda n: F.when(F.col(n).isNotNull(), F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    pair = lambda c, i, d, j: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"))
    c, s = F.col("class"), F.col("sub")
    own = F.transform(upto("n1"), lambda o: pair(c, F.least(s, o), c, F.greatest(s, o)))
    below = F.transform(upto("n2"), lambda o: pair(c - 1, o, c, s))
    above = F.transform(upto("n0"), lambda o: pair(c, s, c + 1, o))
    return rows.select("key", F.explode(F.concat(own, below, above)).alias("p"), "payload").select("key", "p.*", "payload")


def cross_links(members: DataFrame, reps: DataFrame, sets: DataFrame, hashes: int, rows: int, least: list[tuple[int, int]], percent: int, hot: list[int]) -> DataFrame:
    """Links (a, b) that join different components in each bucket of members (key, rep, component, size).

    Pairs of blocks are groups of two rows at most.  Links that the group's own links make needless are left out, so it
    has fewer links than members.
    """
    met = meetings(packed_blocks(members, reps, sets, percent, hot), hot)
    names = ["key", "c", "i", "d", "j"]
    met = met.repartition(*names).sortWithinPartitions(*names)

    def compare(key: int, payloads: list[bytes]) -> list[tuple[int, int]]:
        parts = [from_bytes(p) for p in payloads]
        t = pa.concat_tables(parts)
        block = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
        rep, comp = (t.column(c).to_numpy().copy() for c in ("rep", "component"))
        if len(rep) < 2 or (comp == comp[0]).all():
            return []
        sig = _sigs(t.column("sig").combine_chunks(), hashes)
        full = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
        size = np.array([len(x) for x in full])
        band = next(b for b in range(hashes // rows) if band_key(sig[:1], b, rows)[0] == key)
        found = []
        for x in range(len(rep) - 1):
            use = (comp[x + 1 :] != comp[x]) & (100 * np.minimum(size[x + 1 :], size[x]) >= percent * np.maximum(size[x + 1 :], size[x]))
            if len(parts) > 1:
                use &= block[x + 1 :] != block[x]
            y = x + 1 + np.flatnonzero(use)
            if band and len(y):  # a pair that agrees on an earlier band is compared there
                y = y[~(sig[y, : band * rows] == sig[x, : band * rows]).reshape(len(y), band, rows).all(axis=2).any(axis=1)]
            if len(y):
                y = y[survive(np.broadcast_to(sig[x], (len(y), hashes)), sig[y], least)]
            if not len(y):
                continue
            both = np.bincount(np.repeat(np.arange(len(y)), size[y]), np.isin(np.concatenate([full[i] for i in y]), full[x]), len(y))
            for i in y[100 * both >= percent * (size[x] + size[y] - both)].tolist():
                if comp[i] != comp[x]:
                    comp[comp == comp[i]] = comp[x]
                    found.append((min(int(rep[x]), int(rep[i])), max(int(rep[x]), int(rep[i]))))
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        payloads: list[bytes] = []
        for batch in batches:
            for at, payload in zip(zip(*(batch.column(n).to_pylist() for n in names), strict=True), batch.column("payload"), strict=True):
                if at != held:
                    if held:
                        yield out(compare(held[0], payloads))
                    held, payloads = at, []
                payloads.append(payload.as_py())
        if held:
            yield out(compare(held[0], payloads))

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(tidied(work), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = 120, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of every row; text_key: xxhash64 of the text."""
    threshold = percent / 100
    rows, least = bands_of(threshold, hashes, miss), least_matches(threshold, hashes, miss)
    all_rows = written(signed(docs, k, hashes), "signatures")
    usable = all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    bands = written(banded(reps, hashes, rows), "bands")
    heads = bands.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    heads = written(heads, "buckets")
    hot = hot_keys(heads, "key", reps.count() * (hashes // rows))
    star = written(hot_join(bands, heads.select("key", "a"), ["key"], hot).where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "star-pairs")
    links = written(verified(written(plausible(star, reps, hashes, least), "survivors"), reps, docs, k, percent), "star-links")
    found = written(components(links), "star-components")
    members = hot_join(bands, heads.select("key"), ["key"], hot).join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
    members = written(members, "members")
    mixed = written(members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "open-keys")
    open_ = written(hot_join(members, mixed, ["key"], hot), "open-buckets")
    if not open_.isEmpty():
        sets = full_sets_of(open_.select("rep").distinct(), reps, docs, k)
        new = written(cross_links(open_, reps, sets, hashes, rows, least, percent, hot), "cross-links")
        if not new.isEmpty():  # links between the components found so far
            of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
            between = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
            merged = written(components(between), "merged-components")
            old = found.select("node", "component").union(between.select("a", "a")).union(between.select("b", "b")).distinct()
            found = old.join(merged.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
            found = written(found, "all-components")
    classes = reps.select("hi", "lo", "rep", "doc").join(found, F.col("rep") == F.col("node"), "left").select("hi", "lo", "doc", F.coalesce("component", "rep").alias("component"))
    classes = written(classes, "class-components")
    names = classes.groupBy("component").agg(F.min("doc").alias("c"))
    classes = classes.join(names, "component").select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), "c")
    out = all_rows.drop("sig").join(classes, F.expr("hi = c_hi AND lo = c_lo AND n_shingles > 0 AND doc_id IS NOT NULL"), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_key")


def _oracle(k: int = 3, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a),
c AS (SELECT doc_id, min(m) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""


ORACLE = _oracle()
