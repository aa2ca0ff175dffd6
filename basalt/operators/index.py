"""Block indexes: what is new, used, referenced, where it lies, and what it amounts to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrences(blocks: DataFrame, *order: str) -> DataFrame:
    """The first reference to each storage key, in walk order; it owns the write.  Partial minima shuffle, not blocks."""
    rest = [c for c in blocks.columns if c not in ("storage_key", *order)]
    first = blocks.groupBy("storage_key").agg(F.min(F.struct(*order, *rest)).alias("x"))
    return first.select("storage_key", "x.*").select(*blocks.columns)


def new_blocks(blocks: DataFrame, base: DataFrame) -> DataFrame:
    """Blocks whose key no base index holds."""
    return blocks.join(base.select("storage_key").distinct(), "storage_key", "left_anti")


def used_entries(base: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries of base indexes that the blocks refer to, in the first index that holds them."""
    return resolved(base).join(blocks.select("storage_key").distinct(), "storage_key", "left_semi")


def resolved(indexes: DataFrame) -> DataFrame:
    """One entry per key of several indexes (ord, storage_key, ...): the index of least ord wins."""
    rest = [c for c in indexes.columns if c not in ("storage_key", "ord")]
    return indexes.groupBy("storage_key").agg(F.min(F.struct("ord", *rest)).alias("x")).select("storage_key", "x.*")


def lookup(keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """keys with the entry that wins; nulls where no index holds the key."""
    return keys.join(resolved(indexes), "storage_key", "left")


def merged(*indexes: DataFrame) -> DataFrame:
    """All entries in the order of their keys; duplicates stay."""
    out = indexes[0]
    for more in indexes[1:]:
        out = out.unionByName(more)
    return out.orderBy("storage_key")


def missing(references: DataFrame, loaded: DataFrame) -> DataFrame:
    """References (archive, referenced) to archives that are not loaded (archive), but for those to themselves."""
    return references.where("archive <> referenced").join(loaded.select(F.col("archive").alias("referenced")), "referenced", "left_anti").select("archive", "referenced")


def running_offsets(blocks: DataFrame, level: list[Column], order: list[str], size: str) -> DataFrame:
    """blocks with offset, the sum of the sizes before them.

    level: coarser and coarser keys, each in the order of the finer one (and of order).  Sums run in each key's
    partition: of the blocks in the finest, of each key's totals in the next coarser; only the coarsest's totals pass
    through one task.
    """
    names = [f"level_{i}" for i in range(len(level))]
    rows = blocks.withColumns(dict(zip(names, level, strict=True)))
    totals = rows.groupBy(*names).agg(F.sum(size).alias("total"))
    before = F.lit(0).cast("long")
    for i, name in enumerate(names):  # what comes before a key within the next coarser one
        above = names[i + 1 :]
        sums = totals.groupBy(name, *above).agg(F.sum("total").alias("t"))
        window = Window.partitionBy(*above).orderBy(name) if above else Window.orderBy(name)
        sums = sums.withColumn("b", F.sum("t").over(window) - F.col("t")).select(*[F.col(n).alias(f"t_{n}") for n in names[i:]], F.col("b").alias(f"b_{i}"))
        totals = totals.join(sums, [F.col(n).eqNullSafe(F.col(f"t_{n}")) for n in names[i:]]).drop(*[f"t_{n}" for n in names[i:]])
        before = before + F.col(f"b_{i}")
    totals = totals.select(*[F.col(n).alias(f"t_{n}") for n in names], before.alias("before"))
    own = F.sum(size).over(Window.partitionBy(*names).orderBy(*order)) - F.col(size)
    on = [F.col(n).eqNullSafe(F.col(f"t_{n}")) for n in names]
    return rows.withColumn("own", own).join(totals, on).withColumn("offset", F.col("own") + F.col("before")).select(*blocks.columns, "offset")


def counters(blocks: DataFrame, base: DataFrame) -> DataFrame:
    """One row: total of all references, dedup of the distinct keys, internal of those that base lacks, external the rest."""
    distinct = blocks.groupBy("storage_key").agg(F.first("block_size").alias("block_size"), F.count(F.lit(1)).alias("refs"))
    flagged = distinct.join(base.select("storage_key").distinct().withColumn("old", F.lit(1)), "storage_key", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    new = F.col("old").isNull()
    out = flagged.agg(total("refs").alias("total_blocks"), total(F.col("refs") * F.col("block_size")).alias("total_bytes"), F.count(F.lit(1)).alias("dedup_blocks"), total("block_size").alias("dedup_bytes"), F.count(F.when(new, 1)).alias("internal_blocks"), total(F.when(new, F.col("block_size"))).alias("internal_bytes"))
    return out.withColumn("external_blocks", F.col("dedup_blocks") - F.col("internal_blocks")).withColumn("external_bytes", F.col("dedup_bytes") - F.col("internal_bytes"))


def fingerprint(index: DataFrame, digits: int = 2) -> DataFrame:
    """(archive, fingerprint): a hash over an index's keys in order.

    Keys are hashed by their leading digits, then those hashes by fewer, two less a level, so that a row holds 256
    hashes at most but for the first level, where it holds 1/16**digits of an index: four digits for each 100 million keys.
    """
    join = lambda x: F.sha2(F.array_join(x, "").cast("binary"), 256)
    parts = index.groupBy("archive", F.substring("storage_key", 1, digits).alias("lead")).agg(join(F.sort_array(F.collect_list("storage_key"))).alias("h"))
    for left in range(digits - 2, -1, -2):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("lead", "h"))), lambda x: x["h"])
        parts = parts.groupBy("archive", F.substring("lead", 1, left).alias("lead2")).agg(join(ordered).alias("h")).withColumnRenamed("lead2", "lead")
    return parts.select("archive", F.col("h").alias("fingerprint"))
