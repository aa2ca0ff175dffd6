"""The pipeline's stages, each on its own input, against brute force."""

import re
import zlib

import corpus_pipeline as pipeline
import pytest
from test_operators import ITEM, ITEMS, SHARED, VOCABULARY, prose, words

LONG = prose(60)
TEXTS = [None, "", "one", LONG, LONG + " more", "x  " + LONG + "\ny", SHARED + "\n " + prose(50), prose(20) + "\n" + SHARED, ITEM, prose(30) + " " + ITEM.translate({c: c - 32 for c in range(97, 123)}) + " end", prose(900) + " " + ITEM, " kept \n as  it is ", SHARED]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return str(d)


def windows(w, n=13):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def covered(w, hits, n=13):
    return {p for i in hits for p in range(i, min(i + n, len(w)))}


def test_near_dedup(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sets = [set(windows(w, 5)) or ({tuple(w)} if w else set()) for w in (words(t, True) for t in TEXTS)]
    top = list(range(len(TEXTS)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    got = pipeline.near_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: TEXTS[i] for i, t in enumerate(top) if t == i} and len(set(top)) < len(TEXTS)


def test_substrings(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, want = {}, {}
    for i, t in enumerate(TEXTS):
        for x in windows(words(t)):
            first.setdefault(x, i)
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = covered(w, [j for j, x in enumerate(windows(w)) if first[x] < i])
        if not gone:
            want[i] = (t or "", len(t or ""))
        elif len(gone) < len(w):
            left = " ".join(x for j, x in enumerate(w) if j not in gone)
            want[i] = (left, len(left))
    got = pipeline.substrings(spark, docs, folder)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == want and len(want) < len(TEXTS)


def test_uncontaminated(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    known = {x for _, t in ITEMS for w in [split(t)] if w for x in windows(w, min(13, len(w)))}
    want = {}
    for i, t in enumerate(TEXTS):
        w = split(t)
        hit = set().union(*(covered(w, [j for j, x in enumerate(windows(w, n)) if x in known], n) for n in {len(x) for x in known}))
        if not (hit and 20 * len(hit) >= len(w)):
            want[i] = t
    got = pipeline.uncontaminated(spark, docs, folder)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want and 10 in want and 9 not in want


def test_run(spark, folder):
    """With one label only the classifier gives its class's share, so all stay; the packed ids are those of the stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pipeline.quality(spark, docs, folder).count() == len(TEXTS)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    pieces = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert all(r.length <= 2048 for r in pieces) and VOCABULARY


def test_quality_drops_the_rejected(spark, folder, tmp_path):
    good = [(100 + i, " ".join(VOCABULARY[:150][(i * 7 + j) % 150] for j in range(40)), "en", "s", 1) for i in range(60)]
    junk = [(200 + i, " ".join(VOCABULARY[150:][(i * 7 + j) % 150] for j in range(40)), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(good + junk, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in good + junk], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    held = [r[0] for r in good + junk if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i in held if i in got} == {i for i in held if i < 200}
