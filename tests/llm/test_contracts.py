"""Odd inputs: texts without letters, long runs, large numbers, repeated rows, clashing names."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stabilis.llm import decontaminate, exact_topk, jaccard_join, language_id, licenses, lm_score, mixing, pii, quality
from stabilis.llm.common import spread_join


def test_pii_long_zeros():
    text = "0" * 5000 + ".1.1.1"
    assert pii.plain(text)["ip"] == [(0, len(text))]
    assert pii.find("1." + "9" * 5000 + ".1.1")[0]["ip"] == []
    assert pii.masked(text) == "<ip>"


@pytest.mark.parametrize("text", ["\u20ac 100", "\u2014 \u2026 \u201c\u201d", "\U0001f600 \U0001f600", "\u00a1123!", "\u0967\u0968\u0969"])
def test_no_letter(text):
    assert not language_id.letters_of(np.frombuffer(text.encode(), np.uint8)).any()


def test_letters_by_category():
    text = "a\u00e9 \u4e2d1\u20ac \U0001d400\u02b0z"
    want = [unicodedata.category(c)[0] == "L" for c in text for _ in c.encode()]
    assert language_id.letters_of(np.frombuffer(text.encode(), np.uint8)).tolist() == want


def test_language_of_signs_and_long_texts(spark):
    words = {"en": "the of and to in that was", "de": "der die und nicht auch ein"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = [(1000, "\u20ac 100"), (1001, "\U0001f600"), (1002, "the of and to " * 60_000), (1003, "")]
    d = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    small = language_id.Settings(train_windows=600, epochs=4)
    got = {r.doc_id: r for r in language_id.identify(d, learn, small).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1003].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "en" and 0.5 < got[1002].score <= 1
    assert language_id.identify(d.filter("false"), learn, small).count() == 0


def test_forward_pass_by_hand():
    """The states and probabilities of a short text, one position at a time."""
    net = language_id.ByteGRU(3, 2, 4)
    text = b"abcab"
    h, p = net.h, {k: v.astype(float) for k, v in net.p.items()}
    states = {}
    for d, order in (("f", range(5)), ("b", range(4, -1, -1))):
        s, states[d] = np.zeros(h), {}
        for t in order:
            x, u = p[d + "x"][text[t]], p[d + "u"]
            zr = np.clip((x[: 2 * h] + s @ u[:, : 2 * h]) / 4 + 0.5, 0, 1)
            n = np.tanh(x[2 * h :] + (zr[h:] * s) @ u[:, 2 * h :])
            s = zr[:h] * s + (1 - zr[:h]) * n
            states[d][t] = s
    prob, _ = net.outputs(np.frombuffer(text, np.uint8)[:, None])
    for t in range(5):
        e = np.exp(states["f"][t] @ p["fo"] + states["b"][t] @ p["bo"] + p["c"])
        assert prob[t, 0] == pytest.approx(e / e.sum(), abs=1e-5)


def ranked(rows, queries, k):
    good = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    out = []
    for q, v in queries:
        a = [int(np.floor(256 * float(x))) for x in v]
        s = sorted((-sum(x * y for x, y in zip(a, w, strict=True)), i) for i, w in good.items() if i != q)
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e6])
def test_topk_is_exact(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=32) * scale).tolist()) for i in range(120)]
    t = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("uid", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_k(t.filter("id % 20 = 0"), t, 5).collect()]
    assert sorted(got) == ranked(rows, [x for x in rows if x[0] % 20 == 0], 5)


def test_topk_numbers_of_any_length():
    rng = np.random.default_rng(8)
    qs, rows = (np.floor(rng.normal(size=(n, 6)) * 1e11) for n in (3, 40))
    a, b = exact_topk.exact(qs, rows)
    assert a.dtype == object
    r, at = exact_topk.best(a @ b.T, np.arange(40), 4, np.ones((3, 40), bool))
    for q in range(3):
        s = sorted((-sum(int(x) * int(y) for x, y in zip(qs[q], w, strict=True)), i) for i, w in enumerate(rows))
        assert at[r == q].tolist() == [i for _, i in s[:4]]


def test_topk_repeated_query_ids_and_no_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [-1.0, 0.0])], "id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in exact_topk.top_k(twice, t, 2).collect())
    assert got == sorted([(0, 1, 9), (0, 2, 8), (0, 1, 1), (0, 2, 2)])
    assert exact_topk.top_k(t.filter("false"), t, 2).count() == exact_topk.top_k(t, t.filter("false"), 2).count() == 0


def test_mix_gives_columns_back(spark):
    rows = [(i, "a b c d", "s", -7, "t", [i]) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, copies array<int>")
    got = mixing.emit_mix(d).collect()
    assert got and all(tuple(r) == rows[r.doc_id] for r in got)


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text, 1, "x", True), (1, text + " more", 2, "y", False), (None, text, 3, None, None), (7, "other words of another text", 4, "z", True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _cls int, _uid string, _some boolean")
    assert sorted(map(tuple, jaccard_join.keep_one(d).collect())) == sorted([rows[1], rows[3]])


def test_jaccard_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = list(words)
    other[::40] = ["x"] * len(other[::40])
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100])), (4, " ".join(words[:50_000]))]
    members, _ = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in jaccard_join.least_ids(members).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_parity_bounds_differences():
    rng = np.random.default_rng(0)
    for n, m in ((5, 7), (100, 60), (700, 900), (1, 0)):
        x, y = (rng.choice(1500, k, replace=False).astype(np.uint64) for k in (n, m))
        assert jaccard_join.differ(jaccard_join.parity(x), jaccard_join.parity(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_spread_join(spark):
    many = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")))
    few = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    for how, n in (("inner", many.join(few, "k").count()), ("left", 5000)):
        got = spread_join(many, few, "k", how)
        assert got.count() == n and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, many.join(few, "k", how).collect()), key=str)


def covered(item: str, text: str, least: int = 3) -> float:
    """Greedy tiling by comparing all places, over whole texts."""
    a, b = item.split(), text.split()
    width = min(least, len(a))
    free_a, free_b = [True] * len(a), [True] * len(b)
    for n in range(len(a), width - 1, -1):
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                if all(free_a[i : i + n]) and all(free_b[j : j + n]) and a[i : i + n] == b[j : j + n]:
                    free_a[i : i + n] = free_b[j : j + n] = [False] * n
                    break
    return free_a.count(False) / len(a)


def test_contamination_against_brute_force(spark):
    """Candidates, coverage and ties of the whole operator on small vocabularies."""
    rng = random.Random(6)
    make = lambda n, k: " ".join(rng.choice("abcdefghijklmnop"[:k]) for _ in range(n))
    items = [(i, make(rng.randint(1, 14), rng.choice([2, 6, 16]))) for i in range(12)] + [(12, "a a a a a a"), (13, "a a a a a a")]
    docs = [(i, make(rng.randint(0, 40), rng.choice([2, 6, 16]))) for i in range(60)] + [(60, items[3][1]), (60, items[3][1]), (61, "a " * 9)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        best = max((covered(t, text[r.doc_id]), -i) for i, t in items)
        assert r.contaminated == (best[0] >= 0.6)
        if r.contaminated:
            assert (r.coverage, -r.item_id) == (pytest.approx(best[0]), best[1])


def test_contamination_of_equal_tokens():
    items = decontaminate.Items([5], ["a " * 50])
    data = np.frombuffer(b"a " * 200_000, np.uint8)
    assert items.best(np.array([0, len(data)]), data, 0.6) == {0: (1.0, 5)}


def test_quality_of_repeated_rows_and_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    again = {r.doc_id: r.score for r in quality.classify(d.union(d.limit(5)), labels).collect()}
    once = {r.doc_id: r.score for r in quality.classify(d, labels).collect()}
    assert again == pytest.approx(once)
    told = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    held = labels.join(told, "doc_id", "left_anti")
    got = quality.classify(d, told).join(held, "doc_id").collect()
    assert len(got) > 10 and sum(r.keep == (r.quality == 1) for r in got) >= 0.9 * len(got)


REAL = {
    "MIT": "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice",
    "Apache-2.0": "# Copyright 2020 Somebody\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n",
    "GPL-3.0": "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() {}",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice",
    "ISC": "// SPDX-License-Identifier: ISC\nint x;",
}


def test_real_notices(spark):
    rows = [(f"d{i}/x.c", t) for i, t in enumerate(REAL.values())] + [("e/x.c", "// SPDX-License-Identifier: Zlib"), ("e/y.c", "it\nis\nfree software that we use\nfor any purpose")]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"d{i}/x.c"] for i in range(len(REAL))] == list(REAL) and got["e/x.c"] is None and got["e/y.c"] is None


def test_license_scan_with_clashing_columns(spark):
    rows = [("a/LICENSE", "Released under the MIT License.", "u", 1, 2.0), ("a/x.py", "code", "v", 3, 4.0)]
    d = spark.createDataFrame(rows, "path string, text string, _own string, _dir int, _cosine double")
    got = sorted(licenses.scan(d).select(*d.columns, "license").collect())
    assert [tuple(r)[:5] for r in got] == rows and [r.license for r in got] == ["MIT", "MIT"]


def test_lm_score_clash_and_long_text(spark):
    rows = [(1, "ab" * 100_000, 0.5, "x"), (2, "ab ab ab", 0.5, "y"), (3, None, 0.5, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, part string")
    got = {r.doc_id: r for r in lm_score.score_texts(d, F.col("doc_id") < 3).collect()}
    assert len(got) == 3 and got[3].n_tokens == 1 and all(r.score < 0 for r in got.values())
    assert got[1].score / 200_000 > got[2].score / 8


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf, tmp_path, name):
    """Nulls, empty texts, repeated rows, an extra column of a clashing name, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, None, None, None, None, "q"), (1, "", "en", "s", 0, None), (2, "words of a text that is fine " * 9, "en", "s", 50, "r"), (2, "words of a text that is fine " * 9, "en", "s", 50, "r")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for k, part in enumerate((d, d.filter("false"))):
        path = str(tmp_path / str(k))
        part.write.parquet(path)
        out = stage(spark, spark.read.parquet(path), sf)
        assert out.columns == d.columns
        got = out.collect()
        assert all(r.copies in ("q", "r", None) for r in got) and (not k or not got)
