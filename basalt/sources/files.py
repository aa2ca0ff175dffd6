"""A directory tree as tables: a walk that filters and prunes, and a reader that cuts contents into blocks.

walk() lists level by level, the directories of a level spread over the executors.  contents() reads files in parts of
bounded size, so that neither many small files nor one huge file make a task longer than others.  The data source
``tree`` offers both as one table, listed by the driver.  Executors must see the tree at the same path.
"""

from __future__ import annotations

import array
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.keys import MAX_DEPTH
from ..functions.rules import Rule, parse
from ..plans.stored import written

STAT = "path string, type string, dev long, mode long, uid long, gid long, rdev long, size long, atime long, mtime long, ctime long, decision string, rule int"
SCHEMA = STAT + ", block_no long, block binary"
KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "dir", stat.S_IFLNK: "link", stat.S_IFCHR: "char", stat.S_IFBLK: "block", stat.S_IFIFO: "fifo", stat.S_IFSOCK: "socket"}
#: Fixed values of the system: the request for a file's flags, and the flag that leaves it out of backups.
GET_FLAGS, NODUMP = 0x80086601, 0x40
GONE = (FileNotFoundError, NotADirectoryError, PermissionError)
#: Bytes of a file that one row of work reads.
PART_BYTES = 64 << 20


def verdict(path: str, rules: list[Rule]) -> tuple[bool, int | None]:
    import re

    for i, r in enumerate(rules):
        if re.match(r.expression(), path, re.S):
            return r.include, i
    return True, None


def flags_of(path: str) -> int:
    """A file's or directory's flags; 0 where the file system keeps none."""
    import fcntl

    try:
        fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK | os.O_NOFOLLOW)
    except OSError:
        return 0
    try:
        got = array.array("l", [0])
        fcntl.ioctl(fd, GET_FLAGS, got, True)
        return got[0]
    except OSError:
        return 0
    finally:
        os.close(fd)


def shown(name: str) -> str:
    """A name as text: bytes that are no UTF-8 become private characters, which real() turns back."""
    return "".join(chr(ord(c) - 0xDC00 + 0xF700) if "\udc80" <= c <= "\udcff" else c for c in name)


def real(path: str) -> str:
    return "".join(chr(ord(c) - 0xF700 + 0xDC00) if "\uf780" <= c <= "\uf7ff" else c for c in path)


class Scan:
    """How directories are listed: rules, and what is left out."""

    def __init__(self, root: str, rules: list[Rule], xdev: bool = False, ignore_nodump: bool = False, save_atime: bool = True):
        self.root, self.rules, self.xdev, self.ignore_nodump, self.save_atime = root, rules, xdev, ignore_nodump, save_atime
        self.device = os.lstat(root).st_dev

    def row(self, path: str, decision: str, rule: int | None) -> tuple | None:
        """The entry's STAT; None if it has gone."""
        try:
            s = os.lstat(os.path.join(self.root, real(path)))
        except GONE:
            return None
        kind = KINDS.get(stat.S_IFMT(s.st_mode))
        if kind is None:
            raise ValueError(f"{path}: unknown file type")
        return (path, kind, s.st_dev, s.st_mode, s.st_uid, s.st_gid, s.st_rdev, s.st_size, int(s.st_atime if self.save_atime else s.st_ctime), int(s.st_mtime), int(s.st_ctime), decision, rule)

    def entries(self, above: str) -> Iterator[tuple]:
        """STAT of each entry of a directory, which may be gone or closed.

        decision: kept; excluded; structural (an excluded directory that is entered, as an earlier include rule may match
        below it); xdev and nodump (directories kept, but empty; files of the latter are excluded).
        """
        try:
            names = sorted(shown(x) for x in os.listdir(os.path.join(self.root, real(above))))
        except GONE:
            return
        for name in names:  # without . and ..
            path = f"{above}/{name}" if above else name
            keep, rule = verdict(path, self.rules)
            if (got := self.row(path, "kept" if keep else "excluded", rule)) is None:
                continue
            whole, is_dir = os.path.join(self.root, real(path)), got[1] == "dir"
            if not keep:
                if not (is_dir and any(r.include and r.may_match_below(path) for r in self.rules[: rule or 0])):
                    yield got
                    continue
                got = (*got[:11], "structural", rule)
            if self.xdev and is_dir and got[2] != self.device:
                got = (*got[:11], "xdev", rule)
            elif not self.ignore_nodump and got[1] in ("dir", "file") and flags_of(whole) & NODUMP:
                got = (*got[:11], "nodump" if is_dir else "nodump-excluded", rule)
            yield got


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


LISTED = pa.schema([("path", pa.string()), ("type", pa.string()), *[(n, pa.int64()) for n in ("dev", "mode", "uid", "gid", "rdev", "size", "atime", "mtime", "ctime")], ("decision", pa.string()), ("rule", pa.int32())])


def walk(spark: SparkSession, root: str, rules: list[Rule] = (), **how) -> DataFrame:
    """STAT of every visited entry below root and of root itself (path ''), excluded ones included.

    A round a level, whose directories are dealt to the executors; each level is written.
    """
    scan = Scan(root, list(rules), **how)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for above in batch.column("path").to_pylist():
                rows = list(scan.entries(above))
                for i in range(0, len(rows), 10_000):
                    yield _batch(rows[i : i + 10_000], LISTED)

    top = scan.row("", "kept", None)
    if top is None or top[1] != "dir":
        raise NotADirectoryError(root)
    level = spark.createDataFrame([top], STAT)
    levels = [level]
    for _ in range(MAX_DEPTH + 1):
        inner = level.where("type = 'dir' AND decision IN ('kept', 'structural')").select("path")
        level = written(inner.repartition("path").mapInArrow(listed, STAT), "walk")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"directories are nested deeper than {MAX_DEPTH}")


def contents(files: DataFrame, root: str, size: int) -> DataFrame:
    """(path, block_no, block) of files and links (path, type, size): their bytes in blocks of one size.

    A file's parts are rows of work of their own; the last one reads on to the end, however long the file is by then.
    """
    per = max(1, PART_BYTES // size)
    parts = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / (per * size)))
    work_rows = files.where("type IN ('file', 'link')").select("path", "type", F.posexplode(parts).alias("i", "part"), F.size(parts).alias("n"))
    schema = pa.schema([("path", pa.string()), ("block_no", pa.int64()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, kind, part, n in zip(*(batch.column(c).to_pylist() for c in ("path", "type", "part", "n")), strict=True):
                for no, block in blocks_of(os.path.join(root, real(path)), kind, size, part * per, None if part == n - 1 else per):
                    rows.append((path, no, block))
                    held += len(block)
                    if held >= 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        yield _batch(rows, schema)

    return work_rows.repartition("path", "part").mapInArrow(read, "path string, block_no long, block binary")


def blocks_of(whole: str, kind: str, size: int, first: int, count: int | None) -> Iterator[tuple[int, bytes]]:
    """(number, block) of a file from a block on, or of a link's target; nothing if it has gone."""
    try:
        if kind == "link":
            yield 0, os.fsencode(os.readlink(whole))
            return
        with open(whole, "rb") as f:
            f.seek(first * size)
            no = first
            while (count is None or no < first + count) and (block := f.read(size)):
                yield no, block
                no += 1
    except GONE:
        return


class Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(None)
        self.rows = rows


class TreeReader(DataSourceReader):
    """The driver lists names and metadata, pruning excluded subtrees; executors read the contents."""

    def __init__(self, options: dict):
        flag = lambda name: options.get(name, "false").lower() == "true"
        rules = parse([tuple(x.split(" ", 1)) for x in options.get("rules", "").split("\n") if x])
        self.scan = Scan(options["path"], rules, flag("xdev"), flag("ignorenodump"), not flag("dontsaveatime"))
        self.size, self.list_only = int(options.get("blksize", 65536)), flag("listonly")
        self.per, self.bytes = int(options.get("filespertask", 256)), int(options.get("bytespertask", PART_BYTES))

    def partitions(self) -> list[Part]:
        parts, held, size, todo = [], [], 0, [""]
        while todo:
            for row in self.scan.entries(todo.pop()):
                if row[1] == "dir" and row[11] in ("kept", "structural"):
                    todo.append(row[0])
                held.append(row)
                size += row[7] if row[1] == "file" else 0
                if len(held) >= self.per or size >= self.bytes:
                    parts.append(Part(held))
                    held, size = [], 0
        return [*parts, Part(held)] if held else parts

    def read(self, part: Part) -> Iterator[tuple]:
        for row in part.rows:
            some = False
            if row[11] in ("kept", "structural") and row[1] in ("file", "link") and not self.list_only:
                for no, block in blocks_of(os.path.join(self.scan.root, real(row[0])), row[1], self.size, 0, None):
                    some = True
                    yield (*row, no, block)
            if not some:
                yield (*row, None, None)


class TreeSource(DataSource):
    """spark.read.format("tree").option("rules", "-I etc\\n-E **").load(path); names may begin with . or _."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
