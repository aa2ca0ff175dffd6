"""Contents cut into blocks of one size, and the key blocks above them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import INLINE_BYTES, KEY_BYTES, MAX_INDIRECTION, REF_KEYS, encryption_key, storage_key
from ..plans.stored import written


def chunked(files: DataFrame, size: int, inline: int = INLINE_BYTES) -> DataFrame:
    """(archive, id, block_no, block) of contents too long to be inlined; the last block of a file may be short."""
    n = F.octet_length("content")
    last = F.ceil(n / size).cast("int") - 1
    rows = files.where(n > inline).select("archive", "id", "content", F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    return rows.select("archive", "id", F.col("block_no").cast("long").alias("block_no"), F.expr(f"substring(content, block_no * {size} + 1, {size})").alias("block"))


def keyed(blocks: DataFrame, salt: bytes) -> DataFrame:
    """blocks with enc_key, storage_key and block_size."""
    rows = blocks.withColumn("enc_key", encryption_key(F.col("block"), salt))
    return rows.withColumn("storage_key", storage_key(F.col("enc_key"))).withColumn("block_size", F.octet_length("block").cast("long"))


def levels(size: Column, block: int) -> Column:
    """How many levels of blocks a content of that size has: 0 is inlined, k > 0 the reference's indirection.

    A level of c blocks has 32 c bytes of keys; those that the reference cannot hold are cut into blocks themselves.
    """
    per = block // KEY_BYTES
    counts = [F.ceil(size / block)]
    for _ in range(MAX_INDIRECTION):
        counts.append(F.ceil(counts[-1] / per))
    found = F.lit(None).cast("int")
    for k in range(MAX_INDIRECTION, 0, -1):
        found = F.when(counts[k - 1] <= REF_KEYS, F.lit(k)).otherwise(found)
    return F.when(size <= INLINE_BYTES, F.lit(0)).otherwise(found)


def key_blocks(data: DataFrame, size: int, salt: bytes, contents: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all blocks by level, references) of keyed data blocks (archive, id, block_no, enc_key, ...).

    Each round joins the keys of a full block's worth of neighbours, in order, into the next level's block, which is
    written: so each level is computed once, from the one below.  Rounds end when all files' keys fit into their
    references, after four at most; a file that needs more raises an error.
    contents: blocks have their bytes too, as column block, null for data blocks.
    """
    per = size // KEY_BYTES
    columns = ["archive", "id", "level", "block_no", "enc_key", "storage_key", "block_size", *(["block"] if contents else [])]
    counts = data.groupBy("archive", "id").agg(F.count(F.lit(1)).alias("n"))
    level = data.withColumn("level", F.lit(1))
    if contents:
        level = level.withColumn("block", F.lit(None).cast("binary"))
    level = written(level.select(*columns).join(counts, ["archive", "id"]), "keys")
    found, refs = [], []
    keys = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "enc_key"))), lambda x: x["enc_key"]).alias("keys")
    for k in range(1, MAX_INDIRECTION + 1):
        found.append(level.select(*columns))
        refs.append(level.where(F.col("n") <= REF_KEYS).groupBy("archive", "id").agg(F.lit(k).alias("indirection"), keys))
        more = level.where(F.col("n") > REF_KEYS)
        if more.isEmpty():
            break
        if k == MAX_INDIRECTION:
            raise ValueError("a content needs more than four levels")
        joined = more.groupBy("archive", "id", F.floor(F.col("block_no") / per).alias("block_no")).agg(keys, F.ceil(F.first("n") / per).alias("n"))
        above = keyed(joined.withColumn("block", F.unhex(F.array_join("keys", ""))), salt).withColumn("level", F.lit(k + 1))
        level = written(above.select(*columns, "n"), "keys")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(found), union(refs)


def expand(refs: DataFrame, stored: DataFrame, size: int, decode: Callable[[Column, Column], Column] = lambda content, key: content, first: int = 0, last: int | None = None) -> DataFrame:
    """(archive, id, block_no, block) of references (archive, id, indirection, keys) over stored (storage_key, content).

    One join a level, each written, until no key blocks are left; a key that is not stored raises an error.  decode: the
    plain block of content and key.  first, last: only the data blocks with these numbers, and the key blocks that lead
    to them, are fetched.
    """
    per = size // KEY_BYTES
    with_key = lambda df: df.withColumn("storage_key", storage_key(F.col("enc_key")))
    width = F.element_at(F.array(*[F.lit(per**i) for i in range(MAX_INDIRECTION)]), F.col("indirection").cast("int"))  # data blocks below a key
    inside = (F.col("block_no") + 1) * width > first
    if last is not None:
        inside &= F.col("block_no") * width <= last

    def fetch(df: DataFrame) -> DataFrame:
        there = with_key(df).join(stored.select("storage_key", "content"), "storage_key", "left")
        content = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("block is missing: "), "storage_key"))).otherwise(F.col("content"))
        return there.withColumn("content", content).withColumn("content", decode(F.col("content"), F.col("enc_key")))

    frontier = refs.where("indirection > 0").select("archive", "id", "indirection", F.posexplode("keys").alias("block_no", "enc_key"))
    frontier = written(frontier.withColumn("block_no", F.col("block_no").cast("long")).where(inside), "frontier")
    leaves = [frontier.where("indirection = 1")]
    for _ in range(MAX_INDIRECTION - 1):
        parents = frontier.where("indirection > 1")
        if parents.isEmpty():
            break
        keys = F.expr(f"transform(sequence(0, octet_length(content) div {KEY_BYTES} - 1), i -> lower(hex(substring(content, i * {KEY_BYTES} + 1, {KEY_BYTES}))))")
        opened = fetch(parents).select("archive", "id", (F.col("indirection") - 1).alias("indirection"), F.col("block_no").alias("parent"), F.posexplode(keys).alias("i", "enc_key"))
        opened = opened.select("archive", "id", "indirection", (F.col("parent") * per + F.col("i")).alias("block_no"), "enc_key")  # every key block but the last is full
        frontier = written(opened.where(inside), "frontier")
        leaves.append(frontier.where("indirection = 1"))
    return fetch(reduce(DataFrame.unionByName, leaves)).select("archive", "id", "block_no", F.col("content").alias("block"))


def joined(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, bytes): the blocks (block_no, block) of each content, put together in order."""
    pieces = F.sort_array(F.collect_list(F.struct("block_no", F.hex("block").alias("h"))))
    return blocks.groupBy(*by).agg(F.unhex(F.array_join(F.transform(pieces, lambda x: x["h"]), "")).alias("bytes"))


def read_range(files: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """(archive, id, bytes): the range of each content, from the blocks it touches alone; empty past the end.

    Only those blocks are cut out of a content, and they stay in its row, so nothing is shuffled.
    """
    first, last = offset // size, (offset + max(length, 1) - 1) // size
    block = lambda i: F.expr(f"substring(content, {i * size + 1}, {size})")
    touched = F.concat(*[block(i) for i in range(first, last + 1)]) if last - first < 64 else F.expr(f"substring(content, {first * size + 1}, {(last - first + 1) * size})")
    return files.select("archive", "id", touched.alias("t")).select("archive", "id", F.expr(f"substring(t, {offset - first * size + 1}, {length})").alias("bytes"))
