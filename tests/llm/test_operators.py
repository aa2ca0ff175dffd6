"""Each operator on nulls, empty and long texts, repeats, clashing columns and empty tables; SQL or brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from basalt.llm import catalogue
from basalt.llm import op02_decontamination as op2
from basalt.llm import op03_katz_backoff as op3
from basalt.llm import op04_minhash_dedup as op4
from basalt.llm import op05_warc as op5
from basalt.llm import op06_best_fit_packing as op6
from basalt.llm import op08_substring_dedup as op8

random.seed(3)
VOCABULARY = ["".join(random.choices("abcdeéfgh", k=random.randint(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


SHARED, ITEM = prose(40), prose(30)
TEXTS = [None, "", " \n", "one", "two words", prose(200), "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", SHARED + " " + prose(50), prose(20) + "\n" + SHARED, prose(30) + " " + ITEM.upper() + " end", ITEM, prose(20000), "a  b c <|endoftext|> d中", "x # | y! " * 30]
TEXTS += [TEXTS[5], TEXTS[5] + " more", *[f"{SHARED} {i}" for i in range(6)]]
ROWS = [(i, t, "en", f"s{i % 2}", len(t or ""), "clash", 1.0) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, score double"
ITEMS = [(1, ITEM), (2, None), (3, ""), (4, prose(60)), (4, ITEM + " tail"), (10, ITEM)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS + [ROWS[5]], SCHEMA).withColumn("lang", F.when(F.col("doc_id") != 4, F.col("lang"))).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(len(TEXTS))] + [(None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (5, "http://b/\r\nz", ""), (6, "http://c", "WARC/1.1\r\n\r\nx"), (7, "u", "y" * 200000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - {"op4_minhash_dedup"}))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    con.sql(f"CREATE TABLE want AS {catalogue.ORACLE_SQL[name]}")
    con.register("got", catalogue.QUERIES[name](spark, folder).toArrow())
    c = ", ".join(con.sql("SELECT * FROM want").columns)
    assert con.sql("SELECT count(*) FROM want").fetchall()[0][0] == len(ROWS) + 1
    assert con.sql(f"(SELECT {c} FROM want EXCEPT ALL SELECT {c} FROM got) UNION ALL (SELECT {c} FROM got EXCEPT ALL SELECT {c} FROM want)").fetchall() == []


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalogue.QUERIES[name](spark, empty).collect() == []


def words(text, lower=False):
    import re

    text = (text or "").translate({c: c + 32 for c in range(65, 91)}) if lower else text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_near_duplicates(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame([(None, TEXTS[5], "en", "s", 1, "", 0.0)], SCHEMA))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op4.near_duplicates(docs, k=3, percent=85).collect()}
    sets = {i: ({tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())) for i, t in enumerate(TEXTS) for w in [words(t, True)]}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    assert got == {(i, len(s), top[i], top[i] == i) for i, s in sets.items()} | {(None, len(sets[5]), None, True)}


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Near copies in several blocks, linked along a chain whose ends are unlike."""
    monkeypatch.setattr(op4, "BLOCK", 64)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"v{j}" for j in range(i // 40)] + base[i // 40 :])) for i in range(600)]
    rows = [(i, t + f" z{i}") for i, t in rows]
    got = op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_katz(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = op3.op3_katz_backoff(spark, folder).collect()
    assert len(got) == len(ROWS) + 1
    model = op3.Model(docs, F.lit(True))
    assert model.n == sum(len(words(r[1], True)) + 1 for r in ROWS + [ROWS[5]])
    for r in got:
        assert r.n_tokens == len(words(TEXTS[r.doc_id], True)) + 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isfinite(r.score) and r.score < 0


def test_warc(spark, folder):
    got = {r.page_id: r for r in op5.op5_warc(spark, folder).collect()}
    assert len(got) == 6
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        body = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(body), op5.base32_sha1(body))
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 5), 5: ("response", None), 6: ("response", None), 7: ("response", None)}


def test_packing(spark, folder):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = op6.op6_best_fit_packing(spark, folder).collect()
    for i, t in enumerate(TEXTS):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_substring_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in op8.substring_dedup(docs, keep=("lang",)).collect():
        w = words(TEXTS[r.doc_id])
        gone = {p for s in r.removed for p in range(s.first, s.past)}
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in gone) and r.n_removed == len(gone)
        assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_short_items_and_large_benchmark(spark, folder, monkeypatch):
    monkeypatch.setattr(op2, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a-b y " + ITEM), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "B"), (2, "a b"), (3, ITEM)], "item_id long, text string")
    got = {r.doc_id: (len(r.positions), r["items"]) for r in op2.decontaminate(docs, items).collect()}
    assert got[1][0] == 2 and got[1][1] == ["1", "2"] and got[3] == (0, []) and "3" in got[2][1]


@pytest.mark.parametrize("name, label", [("op7_quality_classifier", "held_out"), ("op9_toxicity", "held_out")])
def test_classifiers_cover_all_rows(spark, folder, name, label):
    got = catalogue.QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted([r[0] for r in ROWS] + [5])
    value = "score" if "score" in got[0] else "p_toxic"
    assert all(0 <= r[value] <= 1 and r[label] == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
