"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of 13 consecutive words selects the least hash among its k-word grams (equal hashes are one), so a span of
13 words or more that a document shares with an item selects the same fingerprint on both sides.  Items of fewer words
are looked up apart: for each such length, of which there are 12 at most, the hash of every span of that length.
Windows whose fingerprint occurs in the benchmark are then extended to the item's window (13 words, or the whole
shorter item) and compared word for word.

Rows: one per row of documents.  Rows that share a doc_id are told apart by their text; equal rows get equal results.
Null or empty text: no words, not contaminated.  Items without words are passed over; items that share an id count
once; a null item_id counts as the id ''.  Empty benchmark: no hits.  Empty documents: no rows.  Texts of any length
are taken whole.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_pair, lesser, let, lower_ascii, table, windowed, words_of, written

#: Benchmark tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: No hash of a gram: marks the one row by which a document without hits stays.
STAY = -(2**63)


def cased_words(text: Column) -> Column:
    return words_of(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(w: Column) -> Column:
    return F.transform(w, lower_ascii)


def minima(w: Column, t: int, k: int) -> Column:
    """Per window of t words the least hash of its k-grams.

    Words are hashed in full lower case, which merges more than the contract's A-Z; the extension compares exactly.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(F.lower(x)))
    grams = let(hashes, lambda h: windowed(h, k, hash_pair))
    return let(grams, lambda g: windowed(g, t - k + 1, lesser, overlap=True))


def runs(m: Column) -> Column:
    """Equal neighbours of m, run by run: struct(fp, first, past)."""
    firsts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    whole = let(firsts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(m, i).alias("fp"), i.alias("first"), F.coalesce(F.get(s, j + 1), F.size(m)).alias("past"))))
    return F.when(F.size(m) > 0, whole).otherwise(F.array().cast("array<struct<fp:bigint,first:int,past:int>>"))


def small(df: DataFrame) -> DataFrame:
    """df for broadcast if it is proven to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, list[int]]:
    """(item, size, window text, fingerprint) of every item window, and the sizes of the items that are shorter."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), lowered(cased_words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = written(items, "items")
    sizes = sorted(r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().collect())  # fewer than window
    spans = items.where(F.size("w") >= window).select("item", F.lit(window).alias("size"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("i"))
    spans = spans.select("item", "size", F.slice("w", F.col("i") + 1, window).alias("w"))
    spans = spans.select("item", "size", F.concat_ws(" ", "w").alias("span"), minima(F.col("w"), window, k)[0].alias("fp"))
    for size in sizes:
        some = items.where(F.size("w") == size)
        spans = spans.unionByName(some.select("item", F.lit(size).alias("size"), F.concat_ws(" ", "w").alias("span"), whole_spans(F.col("w"), size)[0].alias("fp")))
    return written(spans, "item-windows"), sizes


def whole_spans(w: Column, size: int) -> Column:
    """The fingerprint of each span of that many words."""
    hashes = F.transform(w, lambda x: F.xxhash64(F.lower(x)))
    return F.transform(let(hashes, lambda h: windowed(h, size, hash_pair)), lambda x: F.xxhash64(x, F.lit(size)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 10, percent: int = 5) -> DataFrame:
    """Per row: doc_id, n_words, the covered word positions' spans, the items found and the verdict."""
    spans, short = benchmark_windows(benchmark, window, k)
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    # 1. join the fingerprints: of each window where the benchmark's are few enough to be broadcast, else of each run
    known = spans.groupBy("fp").agg(F.collect_set("size").alias("sizes"))
    known = known.union(spans.sparkSession.range(1).select(F.lit(STAY).alias("fp"), F.array().cast("array<int>").alias("sizes")))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    stay = F.array(F.struct(F.lit(STAY).alias("fp"), F.lit(-1).alias("first"), F.lit(-1).alias("past")))
    n_words = lambda w: F.size(w).cast("long").alias("n_words")
    if few and not short:
        cut = docs.select(*key, let(cased_words(F.col("text")), lambda w: F.struct(n_words(w), F.array_append(minima(w, window, k), F.lit(STAY)).alias("m"))).alias("x"))
        prints = cut.select("doc_id", "text_key", "x.n_words", F.posexplode("x.m").alias("first", "fp")).withColumn("past", F.col("first") + 1)
    else:
        alone = lambda a: F.transform(a, lambda x, i: F.struct(x.alias("fp"), i.alias("first"), (i + 1).alias("past")))
        every = lambda w: F.concat(let(minima(w, window, k), runs), *[alone(whole_spans(w, size)) for size in short], stay)
        cut = docs.select(*key, let(cased_words(F.col("text")), lambda w: F.struct(n_words(w), every(w).alias("m"))).alias("x"))
        prints = cut.select("doc_id", "text_key", "x.n_words", F.inline("x.m"))
    joined = prints.join(F.broadcast(known) if few else known, "fp").select("doc_id", "text_key", "n_words", "first", "past", "sizes")
    joined = written(joined, "fingerprint-hits")
    rows = joined.where(F.size("sizes") == 0).select("doc_id", "text_key", "n_words")
    found = joined.where(F.size("sizes") > 0).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "past", "sizes")).alias("runs"))
    found = written(found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "runs"), "fingerprint-documents")
    # 2. extend the hits in the documents that have some, word for word; where those are few, no text is shuffled to find them
    same = F.expr("doc_id <=> f_id AND text_key = f_key")
    hit = docs.select(*key, "text").join(small(found.select("f_id", "f_key")), same, "left_semi").dropDuplicates(["doc_id", "text_key"]).join(found, same)
    at = lambda w: F.flatten(F.transform("runs", lambda r: F.flatten(F.transform(r["sizes"], lambda z: F.transform(F.sequence(r["first"], r["past"] - 1), lambda i: F.struct(i.alias("i"), z.alias("size"), F.concat_ws(" ", F.slice(w, i + 1, z)).alias("span")))))))
    spread = hit.select("doc_id", "text_key", F.explode(let(lowered(cased_words(F.col("text"))), at)).alias("s")).select("doc_id", "text_key", "s.*")
    hits = spread.join(small(spans.select("size", "span", "item").distinct()), ["size", "span"])
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("i", "size")), lambda x: F.sequence(x["i"], x["i"] + x["size"] - 1))))
    per = hits.groupBy("doc_id", "text_key").agg(F.array_sort(covered).alias("positions"), F.sort_array(F.collect_set("item")).alias("items"))
    per = per.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "positions", "items")
    out = rows.join(per, F.expr("doc_id <=> h_id AND text_key <=> h_key"), "left").drop("h_id", "h_key")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
    n_hit = F.size("positions").cast("long")
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (n_hit > 0) & (100 * n_hit >= percent * F.col("n_words")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, z, array_to_string(w[i:i+z-1], ' ') AS s FROM (SELECT item, w, least(len(w), 13) AS z, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT id, i, z, array_to_string(w[i:i+z-1], ' ') AS s FROM (SELECT id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM bw) WHERE len(w) >= z)),
h AS (SELECT id, i, dw.z, item FROM dw JOIN bw ON dw.z = bw.z AND dw.s = bw.s),
c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + z)) AS p FROM h) GROUP BY id),
k AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(k.n, 0)::BIGINT AS n_items, sha256(coalesce(k.s, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.id = c.id LEFT JOIN k ON d.id = k.id"""
