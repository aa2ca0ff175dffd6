"""Licence scans by sentence rules, in DataFrame operations only.

A text is split into sentences (at line ends, and at . ! ? ; before white space).  A sentence is normalised: A-Z in
lower case, every run of other ASCII than letters and digits one space.  A known sentence may also run over several of
these pieces, as wrapped notices do, up to the end of a piece or a : before white space, but not over a blank line (one
without letters and digits); it stands where its first piece does, beside the pieces that are known themselves.  Known licence sentences map to identifiers;
the identifiers of a document, in order, are matched against rules, each an ordered list of identifiers that must
follow one another (unknown sentences may stand between them).  A match inside a longer rule's match is not reported.

Rows: one per row of documents; rows that share a doc_id are told apart by their text, equal rows get equal results.
Null or empty text: no sentences.  Sentences found twice count twice.  Empty documents: no rows.  Texts of any length
are scanned whole.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, lower_ascii, table

#: Normalised notice sentences of well-known licences, with identifiers of our own.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "this project is licensed under the mit license",
    8: "this work is licensed under the gnu general public license version 3",
    9: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    10: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    11: "licensed under cc by nc 4 0",
    12: "licensed under cc by 4 0",
    13: "licensed under cc by sa 4 0",
    14: "this work is licensed under a creative commons attribution 4 0 international license",
    15: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    16: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    17: "all rights reserved",
    18: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    19: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    25: "this is free and unencumbered software released into the public domain",
    26: "this work is in the public domain",
    27: "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Ordered rules: licence -> sequences of sentence identifiers.
RULES = {
    "apache-2.0": [[1], [2, 3, 4], [2, 3], [2]], "mit": [[5], [6], [7], [18, 19], [18]], "gpl-3.0": [[8]], "gpl-3.0-or-later": [[9]], "gpl-2.0-or-later": [[10]],
    "cc-by-nc-4.0": [[11], [15]], "cc-by-4.0": [[12], [14]], "cc-by-sa-4.0": [[13], [16]], "all-rights-reserved": [[17]], "bsd-2-clause": [[20, 21, 22]], "bsd-3-clause": [[20, 21, 22, 23]],
    "isc": [[24]], "unlicense": [[25]], "public-domain": [[26]], "mpl-2.0": [[27]],
}
ENDS = r"[.!?;]+(?=[ \t\r\n]|\z)|\n"
COLON = r":+(?=[ \t\r\n]|\z)"
#: A blank line is given a mark of its own, so that it is told apart from what lies between a full stop and a line end.
BLANK, MARK = r"\n(?=[^A-Za-z0-9\x{80}-\x{10FFFF}\n]*\n)", "\x01"
#: First words of a piece that are compared before the rest.
HEAD = 4


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(sentence), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def license_scan(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules: dict[str, list[list[int]]] = RULES) -> DataFrame:
    """Per row: doc_id, the identified sentences struct(position, sentence_id) and matches struct(license, first, past).

    The knowledge base is a parameter of fixed size, never data, so it is broadcast.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(s, s.split(" ")[0], i) for s, i in ((s, i) for i, s in sentences.items())], "sentence string, opener string, sentence_id int")
    ordered = spark.createDataFrame([(name, seq[0], seq) for name, seqs in rules.items() for seq in seqs], "license string, lead int, ids array<int>")
    openers = sorted({s.split(" ")[0] for s in sentences.values()})
    heads = sorted({" ".join(s.split(" ")[:k]) for s in sentences.values() for k in range(1, HEAD + 1)})
    n_words, n_chars = max(len(s.split(" ")) for s in sentences.values()), max(len(s) for s in sentences.values())
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    word = "[A-Za-z0-9\\x{80}-\\x{10FFFF}]+"
    first = lambda s, k: normalised(F.regexp_extract(s, f"{word}(?:[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+{word}){{0,{k - 1}}}", 0))
    likely = lambda x: F.lower(x["head"]).isin(openers) & first(x["s"], HEAD).isin(heads)
    inner = lambda s: F.filter(F.transform(F.split(s, COLON), normalised), lambda y: y != "")
    # a piece holds a word at least, so a known sentence of n words has n pieces at most; an empty one keeps runs off blank lines
    run = lambda tail: F.substring(F.array_join(F.flatten(F.transform(tail, lambda x: F.when(x["head"] == "", F.array(F.lit(""))).otherwise(inner(x["s"])))), "\n"), 1, n_chars + 1)
    pieces = F.transform(F.split(F.regexp_replace(F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, "\x02"), BLANK, "\n" + MARK), ENDS), lambda s, i: F.struct(i.alias("position"), s.alias("s"), F.regexp_extract(s, word, 0).alias("head")))
    pieces = F.filter(pieces, lambda x: (x["head"] != "") | F.contains(x["s"], F.lit(MARK)))
    starts = lambda p: F.filter(F.transform(p, lambda x, j: F.struct(x["position"].alias("position"), x["s"].alias("s"), x["head"].alias("head"), j.alias("j"))), likely)
    runs = let(pieces, lambda p: F.transform(starts(p), lambda x: F.struct(x["position"].alias("position"), F.substring(normalised(x["s"]), 1, n_chars + 1).alias("one"), run(F.slice(p, x["j"] + 1, n_words)).alias("run"))))
    found = docs.select(*key, F.explode(runs).alias("x")).dropDuplicates(["doc_id", "text_key", "x"])
    found = found.select("doc_id", "text_key", "x.position", "x.one", "x.run", F.substring_index("x.one", " ", 1).alias("opener")).join(F.broadcast(known), "opener")
    size = F.length("sentence")
    over = (size > F.length("one")) & F.startswith(F.translate("run", "\n", " "), F.col("sentence")) & F.substring(F.col("run"), size + 1, F.lit(1)).isin("", "\n")
    found = found.where((F.col("one") == F.col("sentence")) | over)
    found = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("position", "sentence_id"))).alias("known"))
    found = found.withColumn("ids", F.col("known.sentence_id"))
    hits = found.select("*", F.posexplode("ids").alias("first", "lead")).withColumnRenamed("ids", "all_ids").join(F.broadcast(ordered), "lead")
    hits = hits.where(F.slice("all_ids", F.col("first") + 1, F.size("ids")) == F.col("ids"))
    hits = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("license", "first", (F.col("first") + F.size("ids")).alias("past")))).alias("m"))
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), F.expr("filter(m, x -> NOT exists(m, y -> y.first <= x.first AND y.past >= x.past AND y.past - y.first > x.past - x.first))").alias("matches"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "known").join(hits, F.expr("f_id <=> h_id AND f_key = h_key"), "left").drop("h_id", "h_key")
    out = docs.select(*key).join(found, F.expr("doc_id <=> f_id AND text_key = f_key"), "left").drop("f_id", "f_key")
    empty = F.array().cast("array<struct<position:int,sentence_id:int>>"), F.array().cast("array<struct<license:string,first:int,past:int>>")
    return out.select("doc_id", F.coalesce("known", empty[0]).alias("known"), F.coalesce("matches", empty[1]).alias("matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select("doc_id", F.size("known").cast("long").alias("n_known"), F.array_join(F.transform("known", lambda x: x["sentence_id"].cast("string")), ",").alias("sentence_ids"), F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{n}', {seq[0]}, {seq})" for n, seqs in RULES.items() for seq in seqs)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;]+([ \t\r\n])', chr(10) || '\1', 'g'), '[.!?;]+\z', chr(10)), chr(10)) AS p FROM documents),
k AS (SELECT * FROM (VALUES {known}) AS v(s, sid)), r AS (SELECT * FROM (VALUES {rules}) AS v(license, lead, ids)),
s AS (SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM d),
f AS (SELECT id, list(sid ORDER BY i) AS ids FROM s JOIN k ON trim(regexp_replace(translate(s.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) = k.s GROUP BY id),
p AS (SELECT id, ids, unnest(ids) AS lead, generate_subscripts(ids, 1) AS i FROM f),
m AS (SELECT DISTINCT p.id, r.license, p.i AS a, p.i + len(r.ids) AS b FROM p JOIN r ON p.lead = r.lead WHERE p.ids[p.i:p.i+len(r.ids)-1] = r.ids),
x AS (SELECT id, list(DISTINCT license ORDER BY license) AS names FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS y WHERE y.id = m.id AND y.a <= m.a AND y.b >= m.b AND y.b - y.a > m.b - m.a) GROUP BY id)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(len(names), 0)::BIGINT AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses
FROM d LEFT JOIN f ON d.id = f.id LEFT JOIN x ON d.id = x.id"""


ORACLE = _oracle()
