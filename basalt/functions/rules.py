"""Ordered include and exclude rules over paths.

A rule is a list of name patterns (*, ?, [...] and backslash escapes; ** for any number of names).  The first rule that
matches a path, or one of the directories above it, decides; without one the path is included.  As a rule that comes
later than a deciding one can never decide below it, the verdict is that of the lowest rule whose expression matches
the path or a leading part of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    include: bool
    names: tuple[str, ...]

    @classmethod
    def parse(cls, include: bool, pattern: str) -> Rule:
        names = tuple(pattern.split("/"))
        for i, name in enumerate(names):
            if name in ("", ".", ".."):
                raise ValueError(f"{pattern!r}: a name may not be empty, . or ..")
            if name == "**" and i and names[i - 1].startswith("**"):
                raise ValueError(f"{pattern!r}: ** may not follow a name that begins with **")
        return cls(include, names)

    def expression(self, below: bool = True) -> str:
        """A regular expression of the paths that the rule matches; below: of what lies below them too."""
        out = ""
        for i, name in enumerate(self.names):
            last = i == len(self.names) - 1
            if name == "**":
                out += ".+" if last else "(?:[^/]+/)*"
            else:
                out += glob(name) + ("" if last else "/")
        return f"^{out}(?:/.*)?$" if below else f"^{out}$"

    def may_match_below(self, directory: str) -> bool:
        """Could the rule match something below the directory?  (For pruning; errs towards yes.)"""
        parts = directory.split("/") if directory else []
        for name, part in zip(self.names, parts, strict=False):
            if name == "**":
                return True
            if not re.fullmatch(glob(name), part, re.S):
                return False
        return len(self.names) > len(parts)


def glob(name: str) -> str:
    """A name pattern as a regular expression; wildcards match leading dots too."""
    out, i = "", 0
    while i < len(name):
        c = name[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(name):
            out += re.escape(name[i])
            i += 1
        elif c == "[" and (end := name.find("]", i + 1 + (name[i : i + 1] in "!^"))) > 0:
            body = name[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[^/" + body[1:] + "]" if body[0] in "!^" else f"[{body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def parse(rules: list[tuple[str, str]]) -> list[Rule]:
    """rules: ("-I" or "-E", pattern) in order."""
    return [Rule.parse(flag == "-I", pattern) for flag, pattern in rules]


def deciding_rule(path: Column, rules: list[Rule]) -> Column:
    """The 0-based rule that decides the path, null if none does."""
    return F.coalesce(*[F.when(path.rlike("(?s)" + r.expression()), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))


def included(path: Column, rules: list[Rule]) -> Column:
    which = deciding_rule(path, rules)
    return F.when(which.isNull(), F.lit(True)).otherwise(F.get(F.array(*[F.lit(r.include) for r in rules]) if rules else F.array(F.lit(True)), which))


def decisions(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """files (path, ...) with rule and decision: kept, excluded, or structural.

    structural: an excluded directory below which an include rule ahead of the deciding one may still match; it is
    entered, and stored, for what may lie in it.
    """
    which = deciding_rule(F.col("path"), rules)
    alive = F.lit(False)
    for i, r in enumerate(rules):
        if r.include:
            prefixes = [glob(n) for n in r.names]
            if "**" in r.names:
                cut = r.names.index("**")
                stem = "/".join(prefixes[:cut])
                some = [f"^{stem}(?:/.*)?$" if stem else "^.*$"]
                prefixes = prefixes[:cut]
            else:
                some = []
            some += [f"^{'/'.join(prefixes[: j + 1])}$" for j in range(len(prefixes) - (0 if some else 1))]
            for expression in some:
                alive |= (which > i) & F.col("path").rlike("(?s)" + expression)
    directory = (F.col("type") == "dir") if "type" in files.columns else F.lit(False)
    kept = included(F.col("path"), rules)
    return files.withColumn("rule", which).withColumn("decision", F.when(kept, "kept").when(directory & alive, "structural").otherwise("excluded"))


def hits(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, include, n) of every rule, 0 where it decided nothing."""
    spark = files.sparkSession
    known = spark.createDataFrame([(i, r.include) for i, r in enumerate(rules)], "rule int, include boolean")
    found = files.select(deciding_rule(F.col("path"), rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return known.join(found, "rule", "left").select("rule", "include", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
