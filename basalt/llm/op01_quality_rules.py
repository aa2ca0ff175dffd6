"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets integer measures.  Per language and source, mergeable quantile sketches of the measures are
built: log-linear histograms (64 exact buckets, then 32 a power of two), whose merge is the sum of their counts,
so that partial sketches combine in any order and a rebuilt part changes nothing.  The sketches of a language's
sources merge into the language's, and those into one of all rows; a group of under ``min_rows`` documents takes
the next larger one's thresholds.  The joined filter keeps a document that passes the base rules and whose measures
lie within its group's fences: the 90th percentile plus max(3 * (90th - median), the measure's least margin), and,
for the word length, as much below the 10th percentile.

Rows: one per input row, repeated rows and doc_ids included.  Null or empty text: no words, so the base rules fail.
Null lang or source: a group of its own.  Ties: fences are inclusive.  Empty table: no rows.  Further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, hash_pair, let, table, windowed, words_of, written

SYMBOLS = "#*$%&|<>"
#: Measures with their least margin above the 90th percentile; all in units of 1/10000, the word length in 1/100 characters.
UPPER = {"symbols": 400, "dup_lines": 3000, "repeats": 1000, "marks": 300, "word_length": 400}
LOWER = {"word_length": 200}
SALTS = 32


def repeated_words(w: Column, k: int) -> Column:
    """How many words lie in k-word windows that the text holds twice or more (64-bit window hashes)."""

    def sorted_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"]))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        covered = let(at, lambda p: F.transform(p, lambda x, j: F.when(j == F.size(p) - 1, k).otherwise(F.least(F.lit(k), F.get(p, j + 1) - x))))
        return F.aggregate(covered, F.lit(0), lambda a, x: a + x)

    return let(windowed(w, k, hash_pair), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(sorted_windows(h)))


def measured(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, lang, source, the base counts and the measures of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(text, SPACES), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w, k).alias("r"), F.length(F.array_join(w, "")).alias("c")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    marks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))
    df = docs.select("doc_id", "lang", "source", by_words.alias("w"), by_lines.alias("l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("s"), marks.alias("m"))
    long = lambda x: F.col(x).cast("long")
    df = df.select("doc_id", "lang", "source", long("w.n").alias("n_words"), long("w.c").alias("word_chars"), long("s").alias("n_symbols"), long("l.d").alias("n_dup_lines"), long("w.r").alias("n_repeat_words"), long("l.n").alias("n_lines"), long("m").alias("n_marks"))
    per = lambda a, b, unit: F.expr(f"{unit} * {a} div greatest({b}, 1L)")
    return df.withColumns({
        "symbols": per("n_symbols", "word_chars", 10000), "dup_lines": per("n_dup_lines", "n_lines", 10000), "repeats": per("n_repeat_words", "n_words", 10000),
        "marks": per("n_marks", "word_chars", 10000), "word_length": per("word_chars", "n_words", 100),
    })


def bucket(v: Column) -> Column:
    """The sketch's bucket of a count: itself below 64, else with all but its six leading bits cleared."""
    cut = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut))


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): of each source in a language, each language, and all rows."""
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in UPPER])).alias("x")
    fine = rows.where("n_words > 0").select("lang", "source", parts).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), (F.col("lang") if i < 2 else F.lit(None).cast("string")).alias("lang"), (F.col("source") if i < 1 else F.lit(None).cast("string")).alias("source")) for i in range(3)])).alias("g")
    return fine.select(levels, "measure", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n_rows, low, high): maps from measure to fence.  A sketch is one bounded array."""
    cells = sketch.groupBy("level", "lang", "source", "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("rows"))

    def quantile(percent: int) -> Column:
        cumulated = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when((a["seen"] + x["n"]) * 100 >= F.col("rows") * percent, x["bucket"])).alias("at")))
        return cumulated["at"]

    cells = cells.select("level", "lang", "source", "measure", "rows", quantile(10).alias("q10"), quantile(50).alias("q50"), quantile(90).alias("q90"))
    margin = lambda kind: F.coalesce(*[F.when(F.col("measure") == m, v) for m, v in kind.items()])
    cells = cells.withColumn("high", F.col("q90") + F.greatest(3 * (F.col("q90") - F.col("q50")), margin(UPPER))).withColumn("low", F.col("q10") - F.greatest(3 * (F.col("q50") - F.col("q10")), margin(LOWER)))
    of = lambda name, m: F.max(F.when(F.col("measure") == m, F.col(name))).alias(f"{name}_{m}")
    return cells.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *[of("high", m) for m in UPPER], *[of("low", m) for m in LOWER])


def quality_rules(docs: DataFrame, k: int = 5, min_words: int = 10, max_repeat_percent: int = 20, min_rows: int = 200) -> DataFrame:
    """Measures, base verdict, the thresholds' level and the verdict of every row."""
    rows = written(measured(docs, k), "quality-measures")
    limits = fences(sketches(rows))
    names = [f"high_{m}" for m in UPPER] + [f"low_{m}" for m in LOWER]
    pick = lambda level: limits.where((F.col("level") == level) & (F.col("rows") >= (min_rows if level < 2 else 0)))
    one, two, three = pick(0), pick(1), pick(2)
    # Keys of the fine sketch that lack rows take the coarser fences; the fences are copied SALTS times so that a hot
    # source's documents spread over as many tasks.
    keys = limits.where("level = 0").select("lang", "source")
    chosen = keys.alias("k").join(one.alias("a"), F.expr("k.lang <=> a.lang AND k.source <=> a.source"), "left").join(two.alias("b"), F.expr("k.lang <=> b.lang"), "left").join(F.broadcast(three).alias("c"), F.lit(True), "left")  # c: one row
    best = lambda n: F.coalesce(F.col(f"a.{n}"), F.col(f"b.{n}"), F.col(f"c.{n}")).alias(n)
    chosen = chosen.select(F.col("k.lang").alias("f_lang"), F.col("k.source").alias("f_source"), F.coalesce("a.level", "b.level", "c.level").alias("level"), *[best(n) for n in names])
    chosen = chosen.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = rows.join(chosen, F.expr("lang <=> f_lang AND source <=> f_source AND salt = f_salt"), "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    within = F.lit(True)
    for m in UPPER:
        within &= F.col(m) <= F.col(f"high_{m}")
    for m in LOWER:
        within &= F.col(m) >= F.col(f"low_{m}")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    k, unit = 5, {m: "100" if m == "word_length" else "10000" for m in UPPER}
    parts = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "marks": ("n_marks", "word_chars"), "word_length": ("word_chars", "n_words")}
    ratios = ", ".join(f"{unit[m]} * {a} // greatest({b}, 1) AS {m}" for m, (a, b) in parts.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE n_words > 0" for m in UPPER)
    levels = " UNION ALL ".join(f"SELECT {i} AS level, {'lang' if i < 2 else 'NULL'} AS lang, {'source' if i < 1 else 'NULL'} AS source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b FROM m" for i in range(3))
    high = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in UPPER.items()) + " END"
    low = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in LOWER.items()) + " END"
    fence = ", ".join([f"max(CASE WHEN measure = '{m}' THEN q90 + greatest(3 * (q90 - q50), {high}) END) AS high_{m}" for m in UPPER] + [f"max(CASE WHEN measure = '{m}' THEN q10 - greatest(3 * (q50 - q10), {low}) END) AS low_{m}" for m in LOWER])
    names = [f"high_{m}" for m in UPPER] + [f"low_{m}" for m in LOWER]
    best = ", ".join(f"coalesce(a.{n}, b.{n}, c.{n}) AS {n}" for n in names)
    within = " AND ".join([f"{m} <= high_{m}" for m in UPPER] + [f"{m} >= low_{m}" for m in LOWER])
    split = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, {split} AS w FROM documents),
win AS (SELECT id, i, array_to_string(w[i:i+{k - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM t WHERE len(w) >= {k})),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + {k})) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM win) WHERE c > 1) GROUP BY id),
ln AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS d FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY id),
base AS (SELECT t.id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks
  FROM t LEFT JOIN rep ON t.id = rep.id LEFT JOIN ln ON t.id = ln.id),
r AS (SELECT *, {ratios}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
m AS ({long}), lv AS ({levels}),
h AS (SELECT level, lang, source, measure, b, count(*) AS n FROM lv GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS seen, sum(n) OVER (PARTITION BY level, lang, source, measure) AS rws FROM h),
q AS (SELECT level, lang, source, measure, max(rws) AS rws, min(CASE WHEN seen * 100 >= rws * 10 THEN b END) AS q10, min(CASE WHEN seen * 100 >= rws * 50 THEN b END) AS q50, min(CASE WHEN seen * 100 >= rws * 90 THEN b END) AS q90 FROM cum GROUP BY ALL),
f AS (SELECT level, lang, source, max(rws) AS rws, {fence} FROM q GROUP BY level, lang, source),
ch AS (SELECT k.lang, k.source, {best} FROM (SELECT lang, source FROM f WHERE level = 0) k
  LEFT JOIN (SELECT * FROM f WHERE level = 0 AND rws >= 200) a ON k.lang IS NOT DISTINCT FROM a.lang AND k.source IS NOT DISTINCT FROM a.source
  LEFT JOIN (SELECT * FROM f WHERE level = 1 AND rws >= 200) b ON k.lang IS NOT DISTINCT FROM b.lang LEFT JOIN (SELECT * FROM f WHERE level = 2) c ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, true) AS kept
FROM r LEFT JOIN ch ON r.lang IS NOT DISTINCT FROM ch.lang AND r.source IS NOT DISTINCT FROM ch.source"""


ORACLE = _oracle()
