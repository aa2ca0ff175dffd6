"""python -m basalt backup|info|ls|stat|read|help: the archive engine's commands."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession


def commands() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basalt", description="Deduplicating archives on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("backup", help="write an archive of a tree; prints the root's reference, which opens it")
    b.add_argument("path")
    b.add_argument("target", nargs="?")
    b.add_argument("index", nargs="*", help="archives whose blocks are referred to, in order")
    b.add_argument("-v", "--verbose", action="store_true")
    b.add_argument("-n", "--no-act", action="store_true")
    for flag in ("--xdev", "--create-midx", "--dont-use-midx", "--dont-save-atime", "--ignore-nodump"):
        b.add_argument(flag, action="store_true")
    codec = b.add_mutually_exclusive_group()
    for name in ("lz4", "lz4hc", "zstd"):
        codec.add_argument(f"--{name}", dest="codec", action="store_const", const=name, default="zstd")
    b.add_argument("-E", dest="rules", action="append", type=lambda p: ("-E", p), default=[], metavar="PATTERN", help="exclude")
    b.add_argument("-I", dest="rules", action="append", type=lambda p: ("-I", p), metavar="PATTERN", help="include; the first rule that matches decides")
    b.add_argument("--blksize", type=int, default=4, choices=range(19), metavar="N", help="blocks of 4096 << N bytes")
    b.add_argument("--salt", default=os.path.expanduser("~/.config/basalt/salt"), help="file of the secret that scopes deduplication")
    i = sub.add_parser("info", help="fingerprints, references and counters")
    i.add_argument("index", nargs="+")
    for name in ("ls", "stat", "read"):
        r = sub.add_parser(name)
        r.add_argument("-R", dest="root", help="the root's reference; else one line of standard input")
        r.add_argument("--stats", action="store_true")
        r.add_argument("entry")
        r.add_argument("index", nargs="+")
    h = sub.add_parser("help")
    h.add_argument("about", nargs="?")
    return top


def main(words: list[str]) -> int:
    top = commands()
    args = top.parse_args(words)
    if args.command == "help":
        top.parse_args([args.about, "-h"] if args.about else ["-h"])
    from .functions.rules import hits, parse
    from .functions.salt import salt_of
    from .plans.archive import Archives, backup, info

    spark = SparkSession.builder.appName("basalt").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "backup":
        if not args.target and not args.no_act:
            top.error("a target is needed but with -n")
        rules = parse(args.rules)
        done = backup(spark, args.path, args.target or "", salt_of(args.salt), args.index, rules, 4096 << args.blksize, args.codec, args.xdev, args.ignore_nodump, not args.dont_save_atime, args.create_midx, not args.dont_use_midx, args.no_act)
        if args.verbose or args.no_act:
            for r in done.log.orderBy("path").toLocalIterator():
                print(r["line"])
        if args.no_act:
            for r in hits(done.log, rules).orderBy("rule").collect():
                print(f"{r['n']:12} -{'I' if r['include'] else 'E'} {args.rules[r['rule']][1]}")
            return 0
        for r in done.changed.toLocalIterator():
            print(f"{r['path']}: {r['read']} bytes read, {r['size']} expected", file=sys.stderr)
        print(done.root)
        return 0
    if args.command == "info":
        good, bad = info(spark, args.index)
        for df in good:
            for key, value in df.first().asDict().items():
                print(f"{key:24} {value}")
        print("\n".join(bad), file=sys.stderr)
        return 0
    archives = Archives(spark, args.index, args.root or sys.stdin.readline())
    archives.check()
    if args.command == "read":
        # a file's bytes, a range of blocks at a time
        path, size, at, step = archives.open(args.entry), archives.lookup(args.entry).first()["size"], 0, 64 << 20
        while at < size:
            sys.stdout.buffer.write(bytes(archives.read(path, at, step).first()[0]))
            at += step
        return 0
    rows = archives.ls(args.entry) if args.command == "ls" else archives.stat(args.entry, args.stats)
    for r in rows.toLocalIterator():
        print(r["name"] if args.command == "ls" else "\n".join(f"{k:12} {v}" for k, v in r.asDict().items() if k != "ref"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
