"""Archives as Parquet tables: backup, info, ls, lookup, stat, open, readlink, read, df.

An archive is a folder of tables: blocks (new blocks only, sealed, in the order of their keys, with running offsets),
meta (one row: block size, codec, counters, fingerprint, archives referred to) and, if asked for, midx (modification
times).  Nothing else is stored: a directory's content is its entries - names, metadata and references, which hold the
keys - in blocks that are keyed and sealed like a file's.  So all that opens an archive is the reference of its root
directory, which backup() returns and does not store.  No entry crosses the end of a block, so blocks of a directory
are made and read apart from each other, and a directory of any size is spread over tasks.  meta comes last, so a folder
without it is no archive; a failed backup removes its folder.

An index (store(..., index_only=True)) is such a folder in which data blocks have all but their bytes: they are made,
keyed, packed and sealed, and their stored sizes kept.  Directories and key blocks are whole, so it can be walked and
measured.  Its magic is another, so it opens as an index only, and is never a base.
"""

from __future__ import annotations

import errno
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.keys import CODECS, INLINE_BYTES, KEY_BYTES, MAX_BLOCK, MAX_DEPTH, MAX_REFERENCED, MIN_BLOCK, compressed, decompressed, keeps_compressed, seal, unseal
from ..functions.rules import Rule
from ..operators.blocks import expand, joined, key_blocks, keyed
from ..operators.index import fingerprint, missing, resolved, running_offsets
from ..operators.tree import pages
from ..sources.files import contents, walk
from .stored import deleted, exists, put, shared_dir, written

MAGIC, INDEX_MAGIC, VERSION = "basalt-archive", "basalt-index", 3
#: Entry: size, rdev, atime, mtime, ctime, mode, uid, gid, then the lengths of user, group and name; after it the reference.
ENTRY = struct.Struct(">QQqqqIIIBBH")
STAT = ("size", "rdev", "atime", "mtime", "ctime", "mode", "uid", "gid")
ROWS = "parent string, name string, " + ", ".join(f"{c} long" for c in STAT) + ", username string, groupname string, ref string"
ROOT = ""
#: Bytes of the longest entry: numbers, a reference, a name of 255 bytes that are no UTF-8 (three each), user and group.
MAX_ENTRY = ENTRY.size + 2 + INLINE_BYTES + 3 * 255 + 2 * 255


# ---- entries ----------------------------------------------------------------------------------------------------


def encoded() -> Column:
    """An entry's hex, of the columns of ROWS."""
    wide = lambda c, digits: F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0)).cast("long")), digits, "0")
    size = lambda c, digits: F.lpad(F.hex(F.octet_length(c).cast("long")), digits, "0")
    numbers = [wide(c, 16 if i < 5 else 8) for i, c in enumerate(STAT)]
    text = [F.hex(F.encode(F.col(c), "UTF-8")) for c in ("name", "username", "groupname")]
    return F.concat(*numbers, size("username", 2), size("groupname", 2), size("name", 4), F.col("ref"), *text)


def directory_blocks(entries: DataFrame, blksize: int) -> DataFrame:
    """(path, block_no, block) of the directories that hold entries (columns of ROWS); a longer entry than MAX_ENTRY is an error.

    Entries stand by name.  An entry's block is that of its offset where blocks hold the block size less MAX_ENTRY, so
    each fits whole.  Offsets are sums within ranges of names, added up over a directory's ranges: no task gets more
    than one range, and the blocks do not depend on where ranges end.
    """
    size = F.expr("length(e) div 2")
    e = F.when(F.length("e") <= 2 * MAX_ENTRY, F.col("e")).otherwise(F.raise_error(F.concat(F.lit("name is too long: "), "name")))
    rows = entries.select(F.col("parent").alias("path"), "name", encoded().alias("e")).withColumn("e", e)
    rows = written(rows.repartitionByRange("path", "name").withColumn("part", F.spark_partition_id()), "entries")
    before = lambda of, by: F.coalesce(F.sum(of).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranges = rows.groupBy("path", "part").agg(F.sum(size).alias("s")).withColumn("base", before("s", Window.partitionBy("path").orderBy("part")))
    rows = rows.withColumn("offset", before(size, Window.partitionBy("path", "part").orderBy("name", "e"))).join(ranges.drop("s"), ["path", "part"])
    rows = rows.withColumn("block_no", F.floor((F.col("base") + F.col("offset")) / (blksize - MAX_ENTRY)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "e"))), lambda x: x["e"]), "")
    return rows.groupBy("path", "block_no").agg(F.unhex(whole).alias("block"))


def parsed(parent: str, data: bytes) -> Iterator[tuple]:
    """ROWS of a block of a directory; an entry that ends early is an error."""
    at = 0
    while at < len(data):
        try:
            *numbers, user, group, name = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            length = data[at] + 2
            ends = [at, at + length, at + length + name, at + length + name + user, at + length + name + user + group]
        except (struct.error, IndexError):
            raise ValueError(f"directory {parent!r} ends inside an entry") from None
        if ends[-1] > len(data):
            raise ValueError(f"directory {parent!r} ends inside an entry")
        ref, name, user, group = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))
        at = ends[-1]
        yield (parent, name.decode(), *numbers, user.decode(), group.decode(), ref.hex())


def entries_of(directories: DataFrame) -> DataFrame:
    """ROWS of blocks of directories (path, block)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent, data in zip(batch.column("path").to_pylist(), batch.column("block"), strict=True):
                rows = list(parsed(parent, data.as_py() or b""))
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate(KINDS)], names=NAMES)

    return directories.select("path", "block").mapInArrow(work, ROWS)


NAMES = ["parent", "name", *STAT, "username", "groupname", "ref"]
KINDS = [pa.string(), pa.string(), *[pa.int64()] * len(STAT), pa.string(), pa.string(), pa.string()]


def path_of() -> Column:
    return F.when(F.col("parent") == ROOT, F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))


def type_of(mode: Column) -> Column:
    known = {0x8: "file", 0x4: "dir", 0xA: "link", 0x2: "char", 0x6: "block", 0x1: "fifo", 0xC: "socket"}
    top = F.shiftright(mode, 12)
    return F.coalesce(*[F.when(top == k, v) for k, v in known.items()])


def opened(refs: DataFrame) -> DataFrame:
    """refs (path, ref) with indirection, keys and inline."""
    payload = F.substring(F.col("ref"), F.lit(5), F.length("ref"))
    level = F.conv(F.substring("ref", 3, 2), 16, 10).cast("int")
    keys = F.expr(f"transform(sequence(0, greatest(length(ref) div {2 * KEY_BYTES} - 1, 0)), i -> substring(ref, i * {2 * KEY_BYTES} + 5, {2 * KEY_BYTES}))")
    valid = F.when(K.valid_ref(F.col("ref")), F.col("ref")).otherwise(F.raise_error(F.concat(F.lit("no valid reference: "), "path")))
    return refs.withColumn("ref", valid).select("path", level.alias("indirection"), F.when(level > 0, keys).alias("keys"), F.when(level == 0, F.unhex(payload)).alias("inline"))


# ---- reading ----------------------------------------------------------------------------------------------------


def resolve(spark: SparkSession, name: str) -> str:
    """The folder of an archive, named with or without .idx."""
    path = name.rstrip("/").removesuffix(".idx")
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(errno.ENOENT, "no archive", path)
    return path


def validated(spark: SparkSession, path: str, magic: str = MAGIC):
    """The meta row of an archive; an error where it contradicts itself."""
    rows = spark.read.parquet(f"{path}/meta").collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: {len(rows)} rows of meta")
    m = rows[0]
    counts = [(m[f"{k}_blocks"], m[f"{k}_bytes"]) for k in ("total", "dedup", "internal")]
    faults = {
        "magic": m["magic"] != magic, "version": m["version"] != VERSION, "codec": m["codec"] not in {c[2] for c in CODECS.values()},
        "block size": not (MIN_BLOCK <= m["blksize"] <= MAX_BLOCK and m["blksize"] & (m["blksize"] - 1) == 0), "references": len(m["referenced"]) > MAX_REFERENCED,
        "counters": min(min(c) for c in counts) < 0 or counts[1][0] < counts[2][0] or counts[1][1] < counts[2][1],
    }
    if bad := [k for k, v in faults.items() if v]:
        raise ValueError(f"{path}: bad {', '.join(bad)}")
    return m


class Archives:
    """The archives at hand, in order of priority; root: the reference that opens the first.

    magic: INDEX_MAGIC opens indexes, of which data blocks cannot be read.
    """

    def __init__(self, spark: SparkSession, names: list[str], root: str | None = None, magic: str = MAGIC):
        self.spark, self.root = spark, root
        self.paths = [resolve(spark, n) for n in names]
        self.rows = [validated(spark, p, magic) for p in self.paths]
        self.meta = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/meta").withColumn("ord", F.lit(i)) for i, p in enumerate(self.paths)]) if names else None

    @property
    def blksize(self) -> int:
        return self.rows[0]["blksize"]

    def stored(self) -> DataFrame:
        """(ord, archive, storage_key, ...) of all stored blocks."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{p}/blocks").withColumn("ord", F.lit(i)) for i, p in enumerate(self.paths)])

    def midx(self, blksize: int) -> DataFrame | None:
        """(ord, archive, key, sealed) of the modification times of all archives that have them and cut blocks alike."""
        parts = [self.spark.read.parquet(f"{p}/midx").select(F.lit(i).alias("ord"), F.lit(m["archive"]).alias("archive"), "key", "sealed") for i, (p, m) in enumerate(zip(self.paths, self.rows, strict=True)) if m["blksize"] == blksize and exists(self.spark, f"{p}/midx")]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def info(self) -> DataFrame:
        """Fingerprint, references and counters of each archive."""
        out = self.meta.orderBy("ord")
        for what in ("blocks", "bytes", "compressed_bytes"):
            out = out.withColumn(f"external_{what}", F.col(f"dedup_{what}") - F.col(f"internal_{what}"))
        return out

    def missing(self) -> DataFrame:
        """Archives that the first one refers to and that are not at hand."""
        refs = self.meta.where("ord = 0").select("archive", F.explode("referenced").alias("referenced"))
        return missing(refs, self.meta.select("archive"))

    def check(self) -> None:
        """An error that names all archives that the first one refers to and that are not at hand."""
        if absent := [r["referenced"] for r in self.missing().collect()]:
            raise FileNotFoundError(errno.ENOENT, "archives referred to are missing", ", ".join(sorted(absent)))

    def df(self) -> DataFrame:
        return self.meta.where("ord = 0").select("blksize", F.expr("dedup_compressed_bytes div blksize").alias("f_blocks"))

    # -- contents

    def _content(self) -> DataFrame:
        best = resolved(self.stored().where("sealed IS NOT NULL").select("storage_key", "ord", "codec", "size", "packed", "sealed"))
        return best.select("storage_key", F.struct("codec", "size", "packed", "sealed").alias("content"))

    def contents(self, refs: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
        """(path, block_no, block) of contents (path, ref); a damaged or missing block raises an error.

        first, last: only these blocks, and what leads to them, are fetched.
        """
        refs = written(opened(refs), "references")
        inline = refs.where("indirection = 0").select("path", F.lit(0).cast("long").alias("block_no"), F.col("inline").alias("block"))
        deep = refs.where("indirection > 0").select(F.lit("").alias("archive"), F.col("path").alias("id"), "indirection", "keys")
        return inline.unionByName(expand(deep, self._content(), self.blksize, decode, first, last).select(F.col("id").alias("path"), "block_no", "block"))

    def _root(self) -> DataFrame:
        if self.root is None:
            raise ValueError("the root's reference opens an archive")
        return self.spark.createDataFrame([(ROOT, self.root.strip().lower())], "path string, ref string")

    def entries(self, directories: DataFrame) -> DataFrame:
        """The entries of directories (path, ref), with path and type."""
        found = entries_of(self.contents(directories))
        return found.withColumn("path", path_of()).withColumn("type", type_of(F.col("mode")))

    def walk(self) -> DataFrame:
        """All entries, level by level."""
        directories, levels = self._root(), []
        for _ in range(MAX_DEPTH + 1):
            level = written(self.entries(directories), "level")
            levels.append(level)
            directories = level.where("type = 'dir'").select("path", "ref")
            if directories.isEmpty():
                return reduce(DataFrame.unionByName, levels)
        raise ValueError(f"directories are nested deeper than {MAX_DEPTH}")

    def lookup(self, path: str) -> DataFrame:
        """The entry at a path, found name by name from the root; an error where there is none."""
        at, found = self._root(), None
        names = [n for n in path.split("/") if n]
        for i, name in enumerate(names):
            found = written(self.entries(at).where((F.col("name") == name) & (F.col("parent") == "/".join(names[:i]))), "entry")
            row = found.first()
            if row is None:
                raise FileNotFoundError(errno.ENOENT, "no entry", path)
            if i + 1 < len(names) and row["type"] != "dir":
                raise NotADirectoryError(errno.ENOTDIR, "no directory", row["path"])
            at = found.select("path", "ref")
        if found is None:  # the root keeps no metadata of its own
            found = self._root().select(F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), *[F.lit(0o40755 if c == "mode" else 0).cast("long").alias(c) for c in STAT], F.lit("").alias("username"), F.lit("").alias("groupname"), "ref", "path", F.lit("dir").alias("type"))
        return found

    def ls(self, directory: str = "", budget: int | None = None, token: int = 0) -> DataFrame:
        """A directory's entries with . and .. first, by name; with a budget the page that the token asks for.

        next: the token of the next page, null after the last.
        """
        at = self.lookup(directory)
        if at.first()["type"] != "dir":
            raise NotADirectoryError(errno.ENOTDIR, "no directory", directory)
        found = self.entries(at.select("path", "ref"))
        dots = self.spark.createDataFrame([(".", 0), ("..", 1)], "name string, number long")
        listed = dots.select(F.lit(directory).alias("parent"), "name", F.lit(directory).alias("path"), F.lit("dir").alias("type"), "number").unionByName(found.select("parent", "name", "path", "type", F.lit(2).cast("long").alias("number")))
        if budget is None:
            return listed.orderBy("number", "name").drop("number")
        rows = listed.select(F.lit(directory).alias("parent_id"), F.concat(F.least("number", F.lit(2)).cast("string"), "name").alias("name"), F.struct("path", "type").alias("id"))
        paged = pages(rows.withColumn("id", F.to_json("id")), budget)
        paged = written(paged, "pages")
        last = paged.agg(F.max("page")).first()[0]
        out = paged.where(F.col("page") == token).select(F.expr("substring(name, 2)").alias("name"), F.get_json_object("id", "$.path").alias("path"), F.get_json_object("id", "$.type").alias("type"), F.col("name").alias("k"))
        return out.orderBy("k").drop("k").withColumn("next", F.lit(token + 1 if token < last else None).cast("long"))

    def stat(self, path: str, stats: bool = False) -> DataFrame:
        """An entry's metadata; nlink is 1, blksize that of the archive.  stats: with its allocated units of 512 bytes."""
        out = self.lookup(path).withColumn("nlink", F.lit(1)).withColumn("blksize", F.lit(self.blksize))
        if not stats:
            return out
        return out.join(self.allocated(out.select("path", "ref")), "path", "left").withColumn("units", F.coalesce("units", F.lit(0).cast("long")))

    def open(self, path: str) -> str:
        """The path of a regular file; errors for directories and anything else."""
        kind = self.lookup(path).first()["type"]
        if kind == "dir":
            raise IsADirectoryError(errno.EISDIR, "a directory", path)
        if kind != "file":
            raise OSError(errno.EIO, f"a {kind}", path)
        return path

    def readlink(self, path: str, limit: int = 4096) -> str:
        row = self.lookup(path)
        if row.first()["type"] != "link":
            raise OSError(errno.EINVAL, "no link", path)
        target = bytes(joined(self.contents(row.select("path", "ref")), "path").first()["bytes"])
        if len(target) >= limit:
            raise OSError(errno.ENAMETOOLONG, "a link's target is too long", path)
        return os.fsdecode(target)

    def read(self, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
        """One row: the bytes of a file from offset on; empty past its end.  Only blocks of the range are fetched."""
        row = self.lookup(path).select("path", "ref")
        first = offset // self.blksize
        last = None if length is None else (offset + max(length, 1) - 1) // self.blksize
        got = self.contents(row, first, last).where(F.col("block_no") >= first)
        whole = row.select("path").join(joined(got, "path"), "path", "left")
        skip = offset - first * self.blksize
        return whole.select(F.coalesce(F.expr(f"substring(bytes, {skip + 1}{'' if length is None else f', {length}'})"), F.lit(b"")).alias("bytes"))

    def allocated(self, refs: DataFrame) -> DataFrame:
        """(path, units): stored bytes of contents (path, ref) that lie in the first archive, in units of 512.

        A key block that another archive holds is not followed, as that archive cannot refer to this one's blocks.
        """
        own = self.spark.read.parquet(f"{self.paths[0]}/blocks").select("storage_key", "codec", "size", "packed", "sealed", "stored_size")
        frontier = opened(refs).where("indirection > 0").select("path", "indirection", F.explode("keys").alias("enc_key"))
        frontier, sums = written(frontier, "frontier"), []
        while True:
            there = frontier.withColumn("storage_key", K.storage_key(F.col("enc_key"))).join(own, "storage_key")
            sums.append(there.groupBy("path").agg(F.sum("stored_size").alias("s")))
            parents = there.where("indirection > 1")
            if parents.isEmpty():
                break
            content = decode(F.struct("codec", "size", "packed", "sealed"), F.col("enc_key"))
            keys = F.expr(f"transform(sequence(0, octet_length(content) div {KEY_BYTES} - 1), i -> lower(hex(substring(content, i * {KEY_BYTES} + 1, {KEY_BYTES}))))")
            frontier = written(parents.withColumn("content", content).select("path", (F.col("indirection") - 1).alias("indirection"), F.explode(keys).alias("enc_key")), "frontier")
        return reduce(DataFrame.unionByName, sums).groupBy("path").agg(F.expr("(sum(s) + 511) div 512").alias("units"))


def info(spark: SparkSession, names: list[str]) -> tuple[list[DataFrame], list[str]]:
    """Info of each archive that is sound, and what is wrong with the others, which are passed over."""
    good, bad = [], []
    for name in names:
        try:
            good.append(Archives(spark, [name]).info())
        except (ValueError, FileNotFoundError) as e:
            bad.append(str(e))
    return good, bad


def decode(content: Column, key: Column) -> Column:
    """The plain block of a stored struct(codec, size, packed, sealed)."""
    body = unseal(content["sealed"], key)
    plain = F.when(~content["packed"], body)
    packed = [decompressed(F.when(content["packed"] & (content["codec"] == name), body), content["size"], name) for name in ("zstd", "lz4")]
    return F.coalesce(plain, *packed)


# ---- writing ----------------------------------------------------------------------------------------------------


@dataclass
class Backup:
    root: str
    #: (path, decision, rule, line) of every visited entry; line: as a verbose run prints it.
    log: DataFrame
    #: (path, size, read): files whose length was another when they were read.
    changed: DataFrame | None = None


def log_of(listing: DataFrame) -> DataFrame:
    shown = F.when(F.col("decision").isin("excluded"), " (excluded)").when(F.col("decision") == "xdev", " (xdev)").when(F.col("decision").startswith("nodump"), " (nodump)").when(F.col("type") == "dir", "/").otherwise("")
    return listing.where(F.col("path") != ROOT).select("path", "decision", "rule", F.concat("path", shown).alias("line"))


def system_names() -> tuple[list, list]:
    import grp
    import pwd

    return [(u.pw_uid, u.pw_name) for u in pwd.getpwall()], [(g.gr_gid, g.gr_name) for g in grp.getgrall()]


def backup(spark: SparkSession, root: str, path: str, salt: bytes, bases: list[str] = (), rules: list[Rule] = (), blksize: int = 65536, codec: str = "zstd", xdev: bool = False, ignore_nodump: bool = False, save_atime: bool = True, create_midx: bool = False, use_midx: bool = True, no_act: bool = False) -> Backup:
    """Writes an archive of a directory tree below path; blocks that bases hold are referred to.

    Files that a base's modification times know by path, size and second are not read.  no_act: lists only.
    """
    listing = walk(spark, root, list(rules), xdev=xdev, ignore_nodump=ignore_nodump, save_atime=save_atime)
    listing = written(listing, "listing")
    if no_act:
        return Backup("", log_of(listing))
    kept = listing.where("decision NOT IN ('excluded', 'nodump-excluded')")
    users, groups = system_names()
    out = store(spark, kept, lambda files: contents(files, root, blksize), path, salt, bases, blksize, codec, create_midx, use_midx, spark.createDataFrame(users, "uid long, name string"), spark.createDataFrame(groups, "gid long, name string"))
    return Backup(out.root, log_of(listing), out.changed)


def with_directories(files: DataFrame) -> DataFrame:
    """files (path, size, mtime, ...) as rows to store, with the directories above them; missing metadata is 0."""
    have = set(files.columns)
    stat = lambda directory: [F.lit({"mode": 0o40755 if directory else 0o100644}.get(c, 0)).cast("long").alias(c) if directory or c not in have else F.col(c).cast("long").alias(c) for c in STAT]
    above = F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    directories = files.select(F.explode(above).alias("path")).distinct().union(files.sparkSession.createDataFrame([(ROOT,)], "path string")).distinct()
    return files.select("path", F.lit("file").alias("type"), *stat(False)).unionByName(directories.select("path", F.lit("dir").alias("type"), *stat(True)))


def store(spark: SparkSession, files: DataFrame, read, path: str, salt: bytes, bases: list[str] = (), blksize: int = 65536, codec: str = "zstd", create_midx: bool = False, use_midx: bool = True, users: DataFrame | None = None, groups: DataFrame | None = None, index_only: bool = False) -> Backup:
    """Writes an archive of files (path, type, STAT; directories and the root '' among them) below path.

    read: files (path, type, size) -> (path, block_no, block), cut at blksize.  Contents are read once, into a table of
    keyed blocks that goes when the archive is written.  index_only: the data blocks' stored sizes without their bytes,
    which then are on no disk.
    """
    if not (MIN_BLOCK <= blksize <= MAX_BLOCK and blksize & (blksize - 1) == 0):
        raise ValueError(f"block size {blksize}")
    if exists(spark, path):
        raise FileExistsError(errno.EEXIST, "an archive is never overwritten", path)
    try:
        return _stored(spark, files, read, path.rstrip("/"), salt, Archives(spark, list(bases)) if bases else None, blksize, codec, create_midx, use_midx, users, groups, index_only)
    except BaseException:
        deleted(spark, path)
        raise


def unmeasured() -> Column:
    """The column measured of blocks that are stored with their bytes."""
    return F.lit(None).cast("struct<packed: boolean, stored_size: bigint>").alias("measured")


def stored_form(blocks: DataFrame, codec: str) -> DataFrame:
    """blocks (block, enc_key, ...) with packed, sealed and stored_size: null where the block is."""
    rows = blocks.withColumn("small", compressed(F.col("block"), codec)).withColumn("packed", keeps_compressed(F.octet_length("block"), F.octet_length("small")))
    on_disk = F.when(F.col("packed"), F.col("small")).otherwise(F.col("block"))
    number = F.when(F.col("packed"), F.lit(1 + list(CODECS).index(codec))).otherwise(F.lit(0))
    return rows.withColumn("sealed", seal(on_disk, F.col("enc_key"), number)).drop("small").withColumn("stored_size", F.octet_length("sealed").cast("long"))


def _stored(spark, files, read, path, salt, bases, blksize, codec, create_midx, use_midx, users, groups, index_only) -> Backup:
    name = path.rpartition("/")[2]
    depth = F.when(F.col("path") == ROOT, 0).otherwise(F.size(F.split("path", "/")))
    files = files.withColumn("depth", depth).withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    for column, known, new in (("uid", users, "username"), ("gid", groups, "groupname")):
        if known is None:
            files = files.withColumn(new, F.lit(""))
        else:
            few = known.where(F.octet_length("name") <= 255).groupBy(column).agg(F.min("name").alias(new))
            files = files.join(few, column, "left").withColumn(new, F.coalesce(new, F.lit("")))
    files = files.withColumn("mtime_key", K.mtime_key(F.col("path"), F.col("size"), F.col("mtime"), salt))
    hits = None
    if use_midx and bases and (known := bases.midx(blksize)) is not None:
        best = known.groupBy(F.col("key").alias("mtime_key")).agg(F.min(F.struct("ord", "archive", "sealed")).alias("x"))
        files = files.join(best, "mtime_key", "left").withColumn("hit", F.when(F.col("type") == "file", F.col("x.archive"))).withColumn("hit_ref", F.when(F.col("type") == "file", K.unseal_ref(F.col("x.sealed"), salt))).drop("x")
        hits = True
    else:
        files = files.withColumn("hit", F.lit(None).cast("string")).withColumn("hit_ref", F.lit(None).cast("string"))
    files = written(files, "files")
    # 1. contents, read once: keyed blocks, the key blocks above them, references
    keyed_path = f"{shared_dir(spark)}/{name}-{os.urandom(8).hex()}"
    try:
        # empty only where decision says so: directories of other devices and such have no entries
        live = files.where("hit IS NULL" + (" AND decision IN ('kept', 'structural')" if "decision" in files.columns else ""))
        data = read(live.select("path", "type", "size"))
        small = (F.col("block_no") == 0) & (F.col("block_size") <= INLINE_BYTES)
        data = keyed(data.select(F.lit(name).alias("archive"), F.col("path").alias("id"), "block_no", "block"), salt).withColumn("measured", unmeasured())
        if index_only:
            data = stored_form(data, codec).withColumn("measured", F.struct("packed", "stored_size")).withColumn("block", F.when(small, F.col("block"))).drop("packed", "sealed", "stored_size")
        put(data, f"{keyed_path}/level=1")
        data = spark.read.parquet(f"{keyed_path}/level=1")
        read_sizes = written(data.groupBy("id").agg(F.sum("block_size").alias("read")), "read-sizes")
        refs = [data.where(small).select(F.col("id").alias("path"), K.ref(F.lit(0), F.hex("block")).alias("ref"))]
        everything = [data.where(~small).select("id", F.lit(1).alias("level"), "block_no", "enc_key", "storage_key", "block_size", "block", "measured")]
        every, deep = key_blocks(data.where(~small).drop("block", "measured"), blksize, salt, contents=True)
        everything.append(every.where("level > 1").select("id", "level", "block_no", "enc_key", "storage_key", "block_size", "block", unmeasured()))
        refs.append(deep.select(F.col("id").alias("path"), K.ref(F.col("indirection"), F.array_join("keys", "")).alias("ref")))
        read_refs = written(reduce(DataFrame.unionByName, refs), "references")
        own = files.join(read_refs, "path", "left").withColumn("ref", F.coalesce("hit_ref", "ref", F.lit("0000")))
        leaves = written(own.where("type <> 'dir'"), "leaves")
        # 2. directories, from the deepest up: their entries are contents like any other
        deepest = files.agg(F.max("depth")).first()[0]
        if deepest > MAX_DEPTH + 1:
            raise ValueError(f"directories are nested deeper than {MAX_DEPTH}")
        below, root = None, None
        columns = ["parent", "name", *STAT, "username", "groupname", "ref"]
        for d in range(deepest, -1, -1):
            here = files.where((F.col("type") == "dir") & (F.col("depth") == d))
            children = leaves.where(F.col("depth") == d + 1).select(*columns)
            children = children if below is None else children.unionByName(below.select(*columns))
            whole = directory_blocks(children, blksize).select(F.lit(name).alias("archive"), F.col("path").alias("id"), "block_no", "block")
            blocks = written(keyed(whole, salt), "directory-blocks")
            small = (F.col("block_no") == 0) & (F.col("block_size") <= (INLINE_BYTES if d else 0))  # so an only block; the root's reference never holds its content
            inline = blocks.where(small).select(F.col("id").alias("path"), K.ref(F.lit(0), F.hex("block")).alias("ref"))
            blocks = blocks.where(~small)
            every, deep = key_blocks(blocks.drop("block"), blksize, salt, contents=True)
            everything.append(blocks.select("id", F.lit(1).alias("level"), "block_no", "enc_key", "storage_key", "block_size", "block", unmeasured()))
            everything.append(every.where("level > 1").select("id", "level", "block_no", "enc_key", "storage_key", "block_size", "block", unmeasured()))
            deep = deep.select(F.col("id").alias("path"), K.ref(F.col("indirection"), F.array_join("keys", "")).alias("ref")).unionByName(inline)
            below = written(here.join(deep, "path", "left").withColumn("ref", F.coalesce("ref", F.lit("0000"))), "directory-entries")
            root = below
        root_ref = root.select("ref").first()["ref"]
        # 3. owners by keys alone, then the bytes of the new ones
        everything = reduce(DataFrame.unionByName, everything)
        keys = everything.groupBy("storage_key").agg(F.min(F.struct("id", "level", "block_no")).alias("o"), F.count(F.lit(1)).alias("refs"), F.first("block_size").alias("size"))
        keys = written(keys.select("storage_key", "o.*", "refs", "size"), "owners")
        old = resolved(bases.stored().select("storage_key", "ord", "archive", "stored_size")) if bases else None
        fresh = keys if old is None else keys.join(old.select("storage_key"), "storage_key", "left_anti")
        rows = everything.select("id", "level", "block_no", "enc_key", "block", "measured").join(fresh.select("id", "level", "block_no", "storage_key", "size"), ["id", "level", "block_no"])
        measure = lambda c: F.coalesce(c, f"measured.{c}").alias(c)
        sealed = stored_form(rows, codec).select(F.lit(name).alias("archive"), "storage_key", F.lit("zstd" if codec == "zstd" else "lz4").alias("codec"), "size", measure("packed"), "sealed", measure("stored_size"))
        put(sealed.repartitionByRange(F.col("storage_key")).sortWithinPartitions("storage_key"), f"{path}/blocks")
    finally:
        deleted(spark, keyed_path)
    if create_midx:
        times = leaves.where("type = 'file'").select(F.col("mtime_key").alias("key"), K.seal_ref(F.col("ref"), F.col("mtime_key"), salt).alias("sealed"))
        put(times.repartitionByRange("key").sortWithinPartitions("key"), f"{path}/midx")
    put(_meta(spark, path, name, keys, old, leaves if hits else None, blksize, codec, INDEX_MAGIC if index_only else MAGIC).coalesce(1), f"{path}/meta")
    changed = leaves.where("type = 'file' AND hit IS NULL").join(read_sizes, F.col("path") == F.col("id"), "left").select("path", "size", F.coalesce("read", F.lit(0).cast("long")).alias("read")).where("size <> read")
    return Backup(root_ref, files.limit(0), written(changed, "changed"))


def _meta(spark, path, name, keys, old, leaves, blksize, codec, magic) -> DataFrame:
    """The counters: a reference counts once in total, a distinct key in dedup, a new block in internal; hits by their size."""
    entries = spark.read.parquet(f"{path}/blocks").select("storage_key", F.lit(None).cast("string").alias("at"), "stored_size")
    if old is not None:
        entries = entries.unionByName(old.select("storage_key", F.col("archive").alias("at"), "stored_size"))
    own = F.col("at").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    meta = keys.join(entries, "storage_key").agg(
        total("refs").alias("total_blocks"), total(F.col("refs") * F.col("size")).alias("total_bytes"), F.count(F.lit(1)).alias("dedup_blocks"), total("size").alias("dedup_bytes"), total("stored_size").alias("dedup_compressed_bytes"),
        F.count(F.when(own, 1)).alias("internal_blocks"), total(F.when(own, F.col("size"))).alias("internal_bytes"), total(F.when(own, F.col("stored_size"))).alias("internal_compressed_bytes"),
        F.collect_set("at").alias("referenced"),
    )
    if leaves is not None:
        found = leaves.where("hit IS NOT NULL").agg(total("size"), F.collect_set("hit")).first()  # archives at hand, which are few
        known = F.array(*[F.lit(x) for x in found[1]]).cast("array<string>")
        meta = meta.withColumn("total_bytes", F.col("total_bytes") + found[0]).withColumn("referenced", F.array_union("referenced", known))
    limit = F.when(F.size("referenced") <= MAX_REFERENCED, F.array_sort("referenced")).otherwise(F.raise_error(F.lit(f"more than {MAX_REFERENCED} archives referred to")).cast("array<string>"))
    index = fingerprint(spark.read.parquet(f"{path}/blocks").select("archive", "storage_key")).first()
    fixed = {"magic": magic, "version": VERSION, "archive": name, "codec": CODECS[codec][2], "index_hash": index["fingerprint"] if index else ""}
    out = meta.withColumn("referenced", limit).withColumn("blksize", F.lit(blksize).cast("long"))
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()})


def offsets(blocks: DataFrame) -> DataFrame:
    """blocks (storage_key, stored_size) with offset: where each lies if they are put together in the order of keys."""
    lead = lambda n: F.substring("storage_key", 1, n)
    return running_offsets(blocks, [lead(4), lead(2)], ["storage_key"], "stored_size")
