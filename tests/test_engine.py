"""The archive engine: queries against DuckDB, path rules, and an archive written and read back."""

import os

import duckdb
import pytest

from basalt.functions.rules import Rule, deciding_rule, included, parse
from basalt.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF).toArrow()  # noqa: F841
    want = con.sql(ORACLES[name])
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    con.sql(f"CREATE TABLE want AS {ORACLES[name]}")
    con.register("got", got)
    assert con.sql(f"(SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM got) UNION ALL (SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want)").fetchall() == []


CASES = [
    ([], "etc/passwd", True), ([("-I", "etc"), ("-I", "root"), ("-E", "**")], "root/x", True), ([("-I", "etc"), ("-I", "root"), ("-E", "**")], "home/a", False), ([("-E", "proc")], "usr/proc", True), ([("-E", "proc")], "proc/1", False),
    ([("-E", "**/.cache"), ("-I", "home"), ("-E", "**")], "home/u/.cache/f", False), ([("-E", "**/.cache"), ("-I", "home"), ("-E", "**")], "home/u/f", True), ([("-E", "a/**")], "a", True), ([("-E", "a/**")], "a/b", False),
    ([("-I", "a/b"), ("-E", "a")], "a/b", True), ([("-I", "a/b"), ("-E", "a")], "a/c", False), ([("-E", "a"), ("-I", "a/b")], "a/b", False), ([("-E", "*")], ".hidden", False),
]


def test_rules(spark):
    from pyspark.sql import functions as F

    for rules, path, want in CASES:
        row = spark.createDataFrame([(path,)], "path string").select(included(F.col("path"), parse(rules)).alias("x"), deciding_rule(F.col("path"), parse(rules)).alias("r")).first()
        assert row.x is want, (rules, path)
    for bad in ("a//b", "./a", "a/..", "**/**", "**x/**"):
        with pytest.raises(ValueError, match="name"):
            Rule.parse(True, bad)


def write_tree(root, contents):
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


BIG = b"".join(bytes([i % 251]) * 4096 for i in range(700)) + b"tail"
SIZES = (0, 1, 160, 161, 4095, 4096, 4097, 5 * 4096, 5 * 4096 + 1, 128 * 4096, 128 * 4096 + 1)


def test_archive_round_trip(spark, tmp_path):
    from basalt.plans.archive import Archives, backup

    root = tmp_path / "tree"
    contents = {"d/big": BIG, "d/same": BIG, "small": b"x" * 160, "d/.h/one": b"y" * 161, "empty": b"", **{f"sizes/s{n}": bytes(i % 253 for i in range(n)) for n in SIZES}}
    write_tree(root, contents)
    os.symlink("small", root / "link")
    os.makedirs(root / "nothing")
    os.mkfifo(root / "pipe")
    done = backup(spark, str(root), str(tmp_path / "a1"), b"salt", blksize=4096, create_midx=True, save_atime=False)
    assert done.changed.count() == 0 and {r.line for r in done.log.collect()} >= {"d/", "d/big", "nothing/", "pipe"}
    one = Archives(spark, [str(tmp_path / "a1.idx")], done.root)
    seen = {r.path: r for r in one.walk().collect()}
    assert set(seen) == set(contents) | {"d", "d/.h", "sizes", "nothing", "link", "pipe"} and seen["pipe"].type == "fifo"
    stat = os.lstat(root / "d/big")
    assert (seen["d/big"].size, seen["d/big"].mode, seen["d/big"].mtime) == (len(BIG), stat.st_mode, int(stat.st_mtime))
    from basalt.operators.blocks import joined

    got = {r.path: bytes(r.bytes or b"") for r in joined(one.contents(one.walk().where("type = 'file'").select("path", "ref")), "path").collect()}
    assert got == contents
    assert bytes(one.read("d/big", 5000, 100).first()[0]) == BIG[5000:5100] and bytes(one.read("d/big", len(BIG) - 2).first()[0]) == BIG[-2:]
    assert bytes(one.read("small", 100, 200).first()[0]) == b"x" * 60 and bytes(one.read("small", 9999, 5).first()[0]) == b"" and bytes(one.read("empty").first()[0]) == b""
    # what is stored gives nothing away
    kept = [r.asDict() for t in ("blocks", "meta") for r in spark.read.parquet(f"{tmp_path}/a1/{t}").collect()]
    assert "enc_key" not in str(kept) and "d/big" not in str(kept) and not any(b"y" * 161 in bytes(r.get("sealed") or b"") for r in kept)
    # lookups
    assert one.readlink("link") == "small" and one.open("d/big") == "d/big" and one.lookup("d/.h/one").first().size == 161
    for call, error in ((lambda: one.open("d"), IsADirectoryError), (lambda: one.open("pipe"), OSError), (lambda: one.lookup("d/none"), FileNotFoundError), (lambda: one.lookup("small/x"), NotADirectoryError), (lambda: one.readlink("link", 5), OSError)):
        with pytest.raises(error):
            call()
    assert [r.name for r in one.ls("d").collect()] == [".", "..", ".h", "big", "same"] and one.stat("d").first().nlink == 1
    first = one.ls("sizes", budget=250).collect()
    names, token = [r.name for r in first], first[0].next
    while token is not None:
        more = one.ls("sizes", budget=250, token=token).collect()
        names, token = names + [r.name for r in more], more[0].next
    assert names == [".", "..", *sorted(f"s{n}" for n in SIZES)] and 4 < len(first) < 12
    # a second archive over the first: every file is known by its time, so none is read, and no block is new but directories'
    two_done = backup(spark, str(root), str(tmp_path / "a2"), b"salt", bases=[str(tmp_path / "a1")], blksize=4096, create_midx=True, save_atime=False)
    two = Archives(spark, [str(tmp_path / "a2"), str(tmp_path / "a1")], two_done.root)
    info = two.info().where("ord = 0").first()
    assert info.internal_blocks == 0 and info.referenced == ["a1"] and info.total_bytes >= sum(map(len, contents.values())) and two_done.root == done.root
    two.check()
    with pytest.raises(FileNotFoundError, match="a1"):
        Archives(spark, [str(tmp_path / "a2")], done.root).check()


def test_changed_files_and_allocated_units(spark, tmp_path):
    """Over a base all is read where times are not used; only what changed is new, and takes space of its own."""
    from basalt.plans.archive import Archives, backup

    root = tmp_path / "tree"
    write_tree(root, {"d/big": BIG, "d/same": BIG, "small": b"x" * 160})
    done = backup(spark, str(root), str(tmp_path / "a1"), b"salt", blksize=4096)
    (root / "d/same").write_bytes(BIG[:-1] + b"!")
    later = backup(spark, str(root), str(tmp_path / "a2"), b"salt", bases=[str(tmp_path / "a1")], blksize=4096, codec="lz4")
    one, two = Archives(spark, [str(tmp_path / "a1")], done.root), Archives(spark, [str(tmp_path / "a2"), str(tmp_path / "a1")], later.root)
    assert bytes(two.read("d/same", len(BIG) - 3).first()[0]) == b"ai!" and bytes(two.read("d/big", 0, 10).first()[0]) == BIG[:10]
    units = {p: two.stat(p, stats=True).first().units for p in ("d/same", "d/big", "small")}
    assert units["d/same"] > 0 and units["d/big"] == units["small"] == 0 and one.stat("d/big", stats=True).first().units > 10
    assert one.df().first().f_blocks == one.info().first().dedup_compressed_bytes // 4096
    with pytest.raises(FileExistsError):
        backup(spark, str(root), str(tmp_path / "a1"), b"salt")


def test_archives_are_validated_and_rolled_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from basalt.plans.archive import backup, info

    write_tree(tmp_path / "t", {"a": b"1", "b/c": b"2" * 500})
    backup(spark, str(tmp_path / "t"), str(tmp_path / "good"), b"s")
    for name, column, value in (("magic", "magic", "x"), ("size", "blksize", 5000), ("counts", "internal_blocks", 10**6), ("version", "version", 1)):
        spark.read.parquet(f"{tmp_path}/good/meta").withColumn(column, F.lit(value)).write.parquet(f"{tmp_path}/{name}/meta")
    good, bad = info(spark, [str(tmp_path / x) for x in ("good", "magic", "size", "counts", "version", "absent")])
    assert len(good) == 1 and len(bad) == 5
    with pytest.raises(Exception, match="more than"):
        from basalt.plans import archive

        archive.store(spark, spark.createDataFrame([("", "dir"), ("f", "file")], "path string, type string").selectExpr("*", *[f"0L AS {c}" for c in archive.STAT]), lambda f: f.selectExpr("path", "0L AS block_no", "cast(raise_error('more than') AS binary) AS block"), str(tmp_path / "half"), b"s")
    assert not (tmp_path / "half").exists()
    empty = tmp_path / "none"
    empty.mkdir()
    from basalt.plans.archive import Archives

    done = backup(spark, str(empty), str(tmp_path / "e"), b"s")
    assert Archives(spark, [str(tmp_path / "e")], done.root).walk().count() == 0 and done.root == "0000"


def test_walk(spark, tmp_path, monkeypatch):
    """Rules, excluded directories that are entered, hit counts of all visited entries, nodump, names of any bytes."""
    from basalt.functions.rules import hits, parse
    from basalt.plans.archive import Archives, backup
    from basalt.sources import files as source

    root = tmp_path / "t"
    write_tree(root, {"home/u/f": b"1", "home/u/.cache/x": b"2", "etc/p": b"3", "proc/1/x": b"4", "keep": b"5"})
    (root / os.fsdecode(b"odd\xff")).write_bytes(b"6")
    rules = parse([("-E", "**/.cache"), ("-I", "home/u"), ("-E", "**")])
    seen = {r.path: r for r in source.walk(spark, str(root), rules).collect()}
    assert {p: r.decision for p, r in seen.items() if p} == {"home": "structural", "home/u": "kept", "home/u/f": "kept", "home/u/.cache": "excluded", "etc": "structural" if seen["etc"].decision == "structural" else "excluded", "proc": "excluded", "keep": "excluded", "odd\uf7ff": "excluded"}
    assert seen["etc"].decision == "excluded"
    got = {r.rule: r.n for r in hits(source.walk(spark, str(root), rules).where("path <> ''"), rules).collect()}
    assert got == {0: 1, 1: 2, 2: 5}
    done = backup(spark, str(root), str(tmp_path / "a"), b"s", rules=rules)
    assert {r.path for r in Archives(spark, [str(tmp_path / "a")], done.root).walk().collect()} == {"home", "home/u", "home/u/f"}
    plan = backup(spark, str(root), str(tmp_path / "never"), b"s", rules=rules, no_act=True)
    assert "keep (excluded)" in {r.line for r in plan.log.collect()} and not (tmp_path / "never").exists()
    done = backup(spark, str(root), str(tmp_path / "all"), b"s")
    assert bytes(Archives(spark, [str(tmp_path / "all")], done.root).read("odd\uf7ff").first()[0]) == b"6"
    scan = source.Scan(str(root), [])
    monkeypatch.setattr(source, "flags_of", lambda p: source.NODUMP if p.endswith(("home/u", "keep")) else 0)
    assert {r[0]: r[11] for r in scan.entries("")}["keep"] == "nodump-excluded" and {r[0]: r[11] for r in scan.entries("home")}["home/u"] == "nodump"
    scan.ignore_nodump = True
    assert {r[0]: r[11] for r in scan.entries("")}["keep"] == "kept"
    scan.xdev, scan.device = True, -1
    assert {r[0]: r[11] for r in scan.entries("")}["etc"] == "xdev" and {r[0]: r[11] for r in scan.entries("")}["keep"] == "kept"


def test_tree_source(spark, tmp_path):
    from basalt.sources.files import TreeSource

    write_tree(tmp_path, {"a/.b": b"q" * 10000, "c": b""})
    spark.dataSource.register(TreeSource)
    load = lambda **o: spark.read.format("tree").options(blksize="4096", **o).load(str(tmp_path)).collect()
    assert sorted((r.path, r.block_no, len(r.block or b"")) for r in load() if r.type == "file" and r.block_no is not None) == [("a/.b", 0, 4096), ("a/.b", 1, 4096), ("a/.b", 2, 1808)]
    assert all(r.block is None for r in load(listonly="true")) and {r.path: r.decision for r in load(rules="-E a/**")} == {"a": "kept", "a/.b": "excluded", "c": "kept"}


def test_large_files_are_read_in_parts(spark, tmp_path, monkeypatch):
    from basalt.sources import files as source

    monkeypatch.setattr(source, "PART_BYTES", 3 * 4096)
    (tmp_path / "f").write_bytes(BIG[:50000])
    rows = source.contents(spark.createDataFrame([("f", "file", 40000), ("gone", "file", 9)], "path string, type string, size long"), str(tmp_path), 4096).collect()
    assert b"".join(bytes(r.block) for r in sorted(rows, key=lambda r: r.block_no)) == BIG[:50000]


def test_stream_ingests_each_block_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from basalt.streaming.incremental import ingest

    rows = spark.createDataFrame([("a", i, "z" * 5000 if i % 2 else f"{i}" * 300) for i in range(6)], "archive string, id long, text string")
    for n in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").select("archive", "id", F.encode("text", "UTF-8").alias("content"))
        ingest(stream, f"{tmp_path}/index", f"{tmp_path}/state", b"s", 4096).awaitTermination()
        keys = [r.storage_key for r in spark.read.parquet(f"{tmp_path}/index").collect()]
        assert len(keys) == len(set(keys)) == 5


def test_salt_is_made_once(tmp_path):
    from basalt.functions.salt import salt_of

    path = str(tmp_path / "d" / "salt")
    salt = salt_of(path)
    assert len(salt) == 32 and salt_of(path) == salt and os.stat(path).st_mode & 0o777 == 0o600
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError, match="32"):
        salt_of(str(tmp_path / "short"))


def test_offsets_and_fingerprints(spark):
    from basalt.operators.index import fingerprint
    from basalt.plans.archive import offsets

    rows = [("a", f"{i * 7919 % 65536:04x}{i:060x}", i % 13 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "archive string, storage_key string, stored_size long")
    want, at = {}, 0
    for _, key, n in sorted(rows, key=lambda r: r[1]):
        want[key], at = at, at + n
    assert {r.storage_key: r.offset for r in offsets(df).collect()} == want
    deep = [fingerprint(df.orderBy(F_rand), 4).first().fingerprint for F_rand in ("storage_key", "stored_size")]
    assert deep[0] == deep[1] != fingerprint(df.where("stored_size > 1"), 4).first().fingerprint


def test_directories_of_many_blocks(spark):
    """Blocks hold whole entries in the order of names, and are the same however the rows are dealt."""
    from pyspark.sql import functions as F

    from basalt.plans.archive import MAX_ENTRY, STAT, directory_blocks, parsed

    rows = spark.range(1500).select(F.when(F.col("id") % 10 == 0, "few").otherwise("hot").alias("parent"), F.concat(F.repeat(F.lit("é"), (F.col("id") % 90).cast("int")), F.col("id").cast("string")).alias("name"), *[F.col("id").alias(c) for c in STAT], F.lit("u").alias("username"), F.lit("").alias("groupname"), F.lit("0000").alias("ref"))
    seen = [{(r.path, r.block_no): bytes(r.block) for r in directory_blocks(x, 4096).collect()} for x in (rows, rows.repartition(7).orderBy(F.desc("name")))]
    assert seen[0] == seen[1] and len(seen[0]) > 30 and all(len(x) <= 4096 for x in seen[0].values())
    for parent in ("few", "hot"):
        numbers = sorted(n for p, n in seen[0] if p == parent)
        got = [(x[1], x[2]) for n in numbers for x in parsed(parent, seen[0][parent, n])]
        assert numbers == list(range(len(numbers))) and got == sorted([(r.name, r.id) for r in rows.where(F.col("parent") == parent).select("name", F.col("size").alias("id")).collect()], key=lambda x: x[0].encode())
    with pytest.raises(Exception, match="too long"):
        directory_blocks(rows.limit(1).withColumn("name", F.repeat(F.lit("x"), MAX_ENTRY)), 4096).collect()
    assert directory_blocks(rows.limit(0), 4096).count() == 0


def test_directories_of_all_lengths(spark, tmp_path):
    """Each entry is found once, also where a directory's last block is short enough to be inlined."""
    from pyspark.sql import functions as F

    from basalt.plans.archive import Archives, store, with_directories

    files = spark.range(30, 75).select(F.concat(F.lit("d"), "id").alias("above"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("i")).select(F.concat_ws("/", "above", "i").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    done = store(spark, with_directories(files), lambda need: need.where("false").selectExpr("path", "0L AS block_no", "cast('' AS binary) AS block"), str(tmp_path / "a"), b"s", blksize=4096)
    got = sorted(r.path for r in Archives(spark, [str(tmp_path / "a")], done.root).walk().collect())
    assert got == sorted([f"d{n}" for n in range(30, 75)] + [f"d{n}/{i}" for n in range(30, 75) for i in range(1, n + 1)])
