"""Directory trees: paths, lookups, paged listings, per-file and whole-archive totals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MAX_DEPTH
from ..plans.stored import written


def paths(entries: DataFrame) -> DataFrame:
    """(id, path, depth) of entries (id, parent_id, name); roots have no parent and the empty path's place.

    A join a level, written, so that each level is computed once, from the one above, until a level is empty; depth is
    limited as in the archive format.
    """
    entries = written(entries.select("id", "parent_id", "name"), "entries")
    level = written(entries.where("parent_id IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("depth")), "level")
    levels = [level]
    for depth in range(1, MAX_DEPTH + 1):
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = written(entries.join(above, "parent_id").select("id", F.concat_ws("/", "above", "name").alias("path"), F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"directories are nested deeper than {MAX_DEPTH}")


def child(entries: DataFrame, parent_id: int, name: str) -> DataFrame:
    return entries.where((F.col("parent_id") == parent_id) & (F.col("name") == name))


def pages(entries: DataFrame, budget: int) -> DataFrame:
    """entries with page: listings cut into replies of budget bytes.

    An entry takes 24 bytes and its name, rounded up to 8, as in a directory reply.  A page ends before the entry that
    would overflow it, so pages depend on the ones before: a sorted directory is passed through once, page by page, and
    only the present page's fill is kept.
    """
    size = F.floor((24 + F.octet_length("name") + 7) / 8) * 8
    rows = entries.select("parent_id", "name", "id", size.cast("long").alias("size"))
    rows = rows.repartition("parent_id").sortWithinPartitions("parent_id", "name", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, used = object(), 0, 0
        for batch in batches:
            parents, sizes = batch.column("parent_id"), batch.column("size").to_numpy()
            n = batch.num_rows
            ends = np.append(np.flatnonzero(np.asarray(pc.fill_null(pc.not_equal(parents.slice(1), parents.slice(0, max(n - 1, 0))), True))) + 1, n)
            total = np.append(0, np.cumsum(sizes))
            out, i = np.empty(n, np.int64), 0
            for end in ends[ends > 0].tolist():
                if (now := parents[i].as_py()) != last:
                    last, page, used = now, 0, 0
                while i < end:
                    stop = min(int(np.searchsorted(total, total[i] + budget - used, "right")) - 1, end)
                    if stop <= i and used:
                        page, used = page + 1, 0
                        continue
                    stop = max(stop, i + 1)
                    out[i:stop] = page
                    used += int(total[stop] - total[i])
                    i = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "page"])

    kind = lambda c: entries.schema[c].dataType.simpleString()
    return rows.mapInArrow(work, f"parent_id {kind('parent_id')}, name string, id {kind('id')}, size long, page long")


def numbered(entries: DataFrame) -> DataFrame:
    """entries with a number within their directory, in the order of names."""
    return entries.withColumn("number", F.row_number().over(Window.partitionBy("parent_id").orderBy("name")))


def allocated(file_blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(archive, id, units): stored bytes of a file's blocks that lie in its own archive's index, in units of 512."""
    own = file_blocks.join(index.select("archive", "storage_key", "compressed_block_size"), ["archive", "storage_key"])
    return own.groupBy("archive", "id").agg(F.expr("(sum(compressed_block_size) + 511) div 512").alias("units"))


def owners(files: DataFrame, users: DataFrame) -> DataFrame:
    """files (uid) with username; missing names, and those over 255 bytes, are empty."""
    known = users.where(F.octet_length("name") <= 255).select("uid", F.col("name").alias("username"))
    return files.join(known, "uid", "left").withColumn("username", F.coalesce("username", F.lit("")))
