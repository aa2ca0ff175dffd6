"""Places where an operator once did less than its whole job; brute force on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import op03_katz_backoff as op3
from basalt.llm import op04_minhash_dedup as op4
from basalt.llm import op06_best_fit_packing as op6
from basalt.llm import op10_license_scan as op10


@pytest.mark.parametrize("order, codes", [(2, 65535), (3, 65535), (4, 10)])
def test_katz_equals_brute_force(spark, monkeypatch, order, codes):
    """Every seen n-gram has its discounted probability, those seen once too; contexts sum to one; hot keys or none."""
    monkeypatch.setattr(op3, "CODES", codes)
    monkeypatch.setattr(op3, "CHUNK", 2000)
    rng = random.Random(5)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(1, 30))) + f" x{i}" for i in range(60)]
    texts += ["", "w0 w1 w2 w3 w4 w5 w6", "w0 w1 w2 w3 w4 w5 w6", "unseen w0 unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learns = lambda i: i % 3 != 0 and i < 63
    c = [None, *[Counter() for _ in range(order)]]
    for i, t in enumerate(texts):
        w = ("<s>", *t.split(), "</s>")
        if learns(i):
            for k in range(1, order + 1):
                c[k].update(w[j - k + 1 : j + 1] for j in range(max(k - 1, 1), len(w)))
    n = sum(c[1].values())
    d = [None, *[op3.good_turing({r: sum(x == r for x in c[k].values()) for r in range(1, op3.TOP + 2)}) for k in range(1, order + 1)]]
    kept = [None, *[{g: d[k][min(x, op3.TOP + 1)] * x for g, x in c[k].items()} for k in range(1, order + 1)]]
    unseen = 1 - sum(kept[1].values()) / n
    followers = {}
    for k in range(2, order + 1):
        for g in c[k]:
            followers.setdefault(g[:-1], []).append(g)

    def p(g):
        if len(g) == 1:
            return kept[1][g] / n if g in kept[1] else unseen
        k, own = len(g), followers.get(g[:-1])
        if not own:
            return p(g[1:])
        used, total = sum(kept[k][x] for x in own), sum(c[k][x] for x in own)
        total += total - used < 1e-9 * total
        return kept[k][g] / total if g in kept[k] else (1 - used / total) / (1 - sum(p(x[1:]) for x in own)) * p(g[1:])

    for h in rng.sample(sorted(followers), 20):
        assert abs(sum(p((*h, *w)) for w in c[1]) + p((*h, "?")) - 1) < 1e-9
    got = {r.doc_id: r for r in op3.scores(docs, op3.Model(docs, (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 63), order)).collect()}
    v = len(c[1])
    for i, t in enumerate(texts):
        w = ("<s>", *t.split(), "</s>")
        assert abs(got[i].score - sum(math.log10(p(w[max(0, j - order + 1) : j + 1])) for j in range(1, len(w)))) < 1e-8, i
        assert abs(got[i].base_score - sum(math.log10((c[1][x,] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])) < 1e-9
        assert (got[i].n_tokens, got[i].n_known) == (len(w) - 1, sum((x,) in c[1] for x in w[1:]))


def test_packing_tries_every_bin():
    """Long pieces: the search goes on past victims that could not be emptied."""
    rng = np.random.default_rng(1)
    for low, high, most in ((400, 901, 836), (550, 1101, 1070)):
        lengths = rng.integers(low, high, 2500)
        bins, offset = op6.pack(lengths, 2048)
        assert np.bincount(bins, weights=lengths).max() <= 2048 and (offset + lengths <= 2048).all()
        assert bins.max() + 1 <= most


def test_packing_exchanges_two_for_one_from_bins_of_many_pieces():
    """A victim of 41 pieces of 10, beside a bin that holds a 19 and has room for 1: two of them take its place."""
    lengths = np.array([980, 19, *[10] * 41])
    bins = op6.Bins(lengths, 1000)
    bins.bin, bins.fill = np.array([0, 0, *[1] * 41]), [999, 410]
    bins._open()
    bins._empty(1)
    assert bins.fill == [1000, 409] and bins.bin[1] == 1


def test_license_notices_wrapped_over_lines(spark):
    mit = """Copyright (c) 2001 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.\n"""
    gpl = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.\n#\n# This program is distributed"""
    mpl = " * This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy\r\n"
    texts = [mit, gpl.format(":", 3), gpl.format(";", 2), mpl, mit.replace("any person", "any\n \nperson"), gpl.format(":", 3).replace("as published", "as\n#\n# published"), "All rights\nreserved by A", "x. ! .\nAll rights.\nreserved\ny"]
    rows = op10.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: ([x.sentence_id for x in r.known], [x.license for x in r.matches]) for r in rows}
    assert got[0] == ([18, 19], ["mit"]) and got[1] == ([9], ["gpl-3.0-or-later"]) and got[2] == ([10], ["gpl-2.0-or-later"]) and got[3] == ([27], ["mpl-2.0"])
    assert got[4] == ([19], []) and got[5] == ([], []) and got[6] == ([], []) and got[7] == ([17], ["all-rights-reserved"])


def test_near_duplicates_of_one_doc_id_with_two_texts(spark, monkeypatch):
    """Rows that share a doc_id are judged each by their own text, in stars and in blocks; the pipeline keeps the other text."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (5, c), (None, a), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op4.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (5, 56, 5, True), (5, 57, 1, False), (6, 57, 1, False), (7, 0, 7, True), (8, 0, 8, True)]
    wide = docs.selectExpr("doc_id", "text", "'en' AS lang", "null AS source", "1L AS n_chars", "'x' AS kept", "0 AS hi")
    left = corpus_pipeline.near_dedup(spark, wide, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, a), (1, b), (5, c), (0, a), (7, ""), (8, "")])


def test_blocks_meet_across_classes_of_size(spark, monkeypatch):
    """Sets of all sizes in one bucket, in blocks of few members: links equal brute force."""
    monkeypatch.setattr(op4, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(base[: rng.randint(100, 900)] + [f"z{i}"])) for i in range(90)]
    got = {r.doc_id: r.component_id for r in op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=97).collect()}
    sets = [set(t.split()) for _, t in rows]
    top = list(range(len(rows)))
    for _ in range(20):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 97 * len(x | y):
                    top[i] = top[j] = min(top[i], top[j])
    assert got == dict(enumerate(top)) and 1 < len(set(top)) < 90


def test_revisits_name_the_response(spark, tmp_path):
    """WARC-Refers-To is the identifier of a record that is there, also where rows repeat; archives are bounded."""
    from basalt.llm import op05_warc as op5

    pages = [(i, f"http://h/{i}", "same" if i % 2 else f"own {i}", "x") for i in range(40)] + [(39, "http://h/39", "same", "y"), (None, None, "lone", None), (None, "u", "lone", "")]
    op5.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string, first string").repartition(3), f"{tmp_path}/w", archive_bytes=4000)
    records = op5.read_warc(spark, f"{tmp_path}/w", payload=True).collect()
    ids = [r.record_id for r in records]
    assert len(ids) == len(set(ids)) == 3 * len(pages) and len({r.archive for r in records}) > 3
    responses = {r.record_id: r for r in records if r.type == "response"}
    revisits = [r for r in records if r.type == "revisit"]
    assert len(revisits) == 19 and all(x.refers_to.rstrip(">") + "/copy-" in " ".join(responses) for x in revisits)
    got = op5.resolved(op5.captures(op5.read_warc(spark, f"{tmp_path}/w"))).where("record.type = 'revisit'").collect()
    assert {r.response.metadata.fields["pageId"] for r in got} == {"39"} and len(got) == 19
    assert all(bytes(r.payload) in (b"same", b"lone") or r.payload.startswith(b"own") for r in responses.values())


def toxic_texts(n):
    rng = random.Random(4)
    plain, bad = [f"plain{i}" for i in range(80)], [f"vile{i}" for i in range(12)]
    y = [rng.random() < 0.4 for _ in range(n)]
    return [" ".join(rng.choices(plain, k=30) + (rng.choices(bad, k=rng.randint(1, 6)) if t else [])) for t in y], [int(t) for t in y]


def test_chain_feeds_earlier_categories_into_the_label():
    """The label is the last link; it is told apart on held-out texts, and its inputs are out-of-fold predictions."""
    import pyarrow as pa

    from basalt.llm import op09_toxicity as op9

    texts, y = toxic_texts(700)
    chain = op9.train([(t, v, i) for i, (t, v) in enumerate(zip(texts[:400], y[:400], strict=True))], {0: 240, 1: 160})
    assert chain.names == ["severe", "repeated", "toxic"] and [len(x.earlier) for x in chain.links] == [0, 1, 2]
    p = chain.predict(pa.array(texts[400:]))
    want = np.array(y[400:])
    assert ((p[:, 2] >= 0.5) == want).mean() > 0.97 and (p[:, 0] <= p[:, 1] + 0.2).all()
    assert np.abs(chain.links[2].earlier).max() > 0.05
    # without the chain's inputs the last link's log odds are others
    odds = lambda x: np.log(x / (1 - x))
    cut = op9.Link(chain.links[2].weights, np.zeros(2), chain.links[2].bias)
    doc, feature = op9.present(pa.array(texts[400:]), chain.bits, chain.low, chain.high, chain.chosen)
    use = (p[:, 2] > 1e-6) & (p[:, 2] < 1 - 1e-6)
    assert np.allclose((odds(p[:, 2]) - odds(cut.predict(doc, feature, p[:, :2])))[use], (p[:, :2] @ chain.links[2].earlier)[use], atol=1e-4) and (p[:, :2] @ chain.links[2].earlier).max() > 0.05


def test_categories_are_judged_by_the_other_folds():
    from basalt.llm import op09_toxicity as op9

    texts = ["bad bad x", "bad y", "bad z bad", "x y", "only only only"]
    y, fold = np.array([1, 1, 1, 0, 1]), np.array([0, 1, 2, 0, 1])
    assert op9.derived(texts, y, fold, {"two": 2, "label": 0}, least=2)[:, 0].tolist() == [1, 0, 1, 0, 0]
    assert op9.derived(texts, y, fold, {"two": 2, "label": 0}, least=3)[:, 0].tolist() == [0, 0, 0, 0, 0]


def test_classifiers_by_held_out_labels(spark, tmp_path):
    """Both classifiers tell classes apart on rows they have not learned from."""
    import zlib

    from basalt.llm import catalogue

    texts, y = toxic_texts(600)
    rows = [(i, t, "en", "s", len(t), 9.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - v, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for name, column, flip in (("op7_quality_classifier", "predicted", 1), ("op9_toxicity", "toxic", 0)):
        got = {r.doc_id: r for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
        assert sum(got[i][column] == (1 - y[i] if flip else y[i]) for i in held) >= 0.95 * len(held), name


def test_packing_ids_are_the_tokenizers(spark):
    """The ids of whole documents, in all languages of the test table, are those of the tokenizer file."""
    import os

    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = pq.read_table(path, columns=["text"]).column("text").combine_chunks()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts.to_pylist(), op6.Encoder(*op6.public_encoder())(texts), strict=True):
        assert ids.tolist() == exact.encode(text or "", add_special_tokens=False).ids


def test_latin_texts_are_encoded_whole():
    """No Latin text is looked up word by word, and texts of all kinds have the tokenizer's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    latin = ["", "one", "a b c", " two  spaces\n\nand lines \t", "naïve Ærø ɏ", "it's 12345 don't!", "x\u00a0y \x85 z", "no\x00thing"]
    other = ["ɐ b c", "日本 語", "a “quoted” word", "  ɐ  b ", "end <|endoftext|> of it", "a <| b", "emoji 🙂 here"]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = op6.Encoder(*op6.public_encoder())
    for texts, words in ((latin, False), (latin + other, True)):
        for text, ids in zip(texts, encoder(pa.array(texts)), strict=True):
            assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids, text
        assert bool(encoder.known) == words


def test_short_items_beside_long_ones(spark):
    """Items of one to twelve words are whole windows; longer ones are found by any 13 of their words."""
    from basalt.llm import op02_decontamination as op2

    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    long = rng.choices(words, k=30)
    items = [(f"s{n}", " ".join(rng.choices(words, k=n))) for n in (1, 2, 5, 12, 13)] + [("long", " ".join(long)), ("none", " - "), (None, None)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(40)] + [items[i][1].upper() + " q " + " ".join(long[3:16]) for i in range(5)] + [" ".join(long[:12]), None]
    split = lambda t: (t or "").lower().replace("-", " ").split()
    windows = {}
    for name, t in items:
        w = split(t)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name or "")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.positions, r["items"]) for r in op2.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, t in enumerate(texts):
        w, at, names = split(t), set(), set()
        for x, found in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    at |= set(range(j, j + len(x)))
                    names |= found
        assert got[i] == (len(w), sorted(at), sorted(names)), i


def test_suffix_tree_nodes():
    """Inner nodes are the distinct common prefixes of two leaves or more, with all their leaves."""
    from basalt.llm import op08_substring_dedup as op8

    rng = np.random.default_rng(3)
    word = rng.integers(0, 3, 400)
    start = np.arange(380)
    for some, deep in op8.prefix_groups(word, start, 6, 60):
        order, shared = op8.sorted_suffixes(word, start, some, deep, 6)
        got = {(d, tuple(word[start[order[a]] : start[order[a]] + d])): sorted(order[a:b].tolist()) for d, a, b in op8.inner_nodes(shared, 1).tolist()}
        want = {}
        for d in range(1, 7):
            for i in some.tolist():
                want.setdefault((d, tuple(word[i : i + d])), []).append(i)
        want = {k: v for k, v in want.items() if len(v) > 1 and (k[0] == 6 or len({word[i + k[0]] for i in v}) > 1)}
        alive = set(order.tolist())
        assert {k: v for k, v in want.items() if k[0] == 6} == {k: v for k, v in got.items() if k[0] == 6}
        assert all(set(v) == set(want[k]) & alive for k, v in got.items())


def test_substrings_in_many_prefix_groups(spark, monkeypatch):
    """Small groups, so that prefixes are of several lengths and buckets many: the same as brute force."""
    from basalt.llm import op08_substring_dedup as op8
    from basalt.llm import shared

    rng = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    passages = [rng.choices(words, k=rng.randint(13, 60)) for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(0, 4)) for w in [*rng.choices(words, k=rng.randint(0, 30)), *rng.choice(passages)]) for _ in range(150)]
    rows = [(i % 140 if i else None, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(op8, "BUCKET_BYTES", 100)
    monkeypatch.setattr(op8, "packed", lambda docs, columns: shared.packed(docs, columns, limit=4000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last, first = 2**63 - 1, {}
    windows = lambda w: [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
    for i, t in rows:
        for x in windows(t.split()):
            first[x] = min(first.get(x, last), last if i is None else i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {p for j, x in enumerate(windows(w)) if first[x] < (last if i is None else i) for p in range(j, j + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    for group in (3, 40):
        got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in op8.substring_dedup(docs, group=group, sample=4).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), group


def test_prefixes_are_counted_in_all_batches(spark, monkeypatch):
    """Each suffix that may repeat is counted once a length, whatever batch it is in: nothing is estimated."""
    from basalt.llm import op08_substring_dedup as op8
    from basalt.llm import shared

    rng = random.Random(4)
    again = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=30)) for _ in range(3)]
    texts = [" ".join(f"x{i}_{j}" for j in range(rng.randint(0, 40))) + " " + (rng.choice(again) if i % 3 else "") for i in range(90)]
    tables = {}

    def kept(name, df):
        tables[name] = df
        return df

    monkeypatch.setattr(op8, "packed", lambda docs, columns: kept("packed", shared.packed(docs, columns, limit=1000)))
    monkeypatch.setattr(op8, "written", lambda df, tag: kept(tag, shared.written(df, tag)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    op8.substring_dedup(docs, sample=4)
    batches = [op8.Stretches(shared.from_bytes(r.payload), 13, 7, 32) for r in tables["packed"].collect()]
    assert len(batches) > 16
    holders = {}
    for s in batches:
        for pick, doc in zip(s.pick.tolist(), s.ids[s.doc].tolist(), strict=True):
            holders.setdefault(pick, set()).add(doc)
    want = sum(len(holders[p]) > 1 for s in batches for p in s.pick.tolist())
    got = {r["length"]: r["n"] for r in tables["prefix-counts"].where("length < 7").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    assert want > 0 and got == {length: want for length in range(1, 7)}
