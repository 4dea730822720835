"""Quality rules, mixing and license scans: odd rows, and what their plans may hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c a b c", "x " * 30_000, "#*$%&|<>", "line\nline\n\nline \n", "the of and " * 40, "mot\x0bà\x0cmot", "a b"]


def rows(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(ODD)], "doc_id long, text string, source string, size int")


def test_quality_counts(spark):
    got = {r.doc_id: r for r in quality.quality_rules(rows(spark)).collect()}
    for i, t in enumerate(ODD):
        t = t or ""
        w = WORD.findall(t)
        seen, hit = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for ks in seen.values():
            if len(ks) > 1:
                hit.update(k + d for k in ks for d in range(3))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), repr(t)[:50]
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = " ".join(f"the word{k} of thing{k * 7} and" for k in range(40))
    junk = " ".join(f"w{k}%%% q{k}$$$" for k in range(60))
    loud = " ".join(f"THE{k}!! OF{k}!!" for k in range(60))
    df = spark.createDataFrame([(1, clean), (2, junk), (3, loud)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(df).collect()} == {1: True, 2: False, 3: False}


def test_mixing(spark):
    data = [(i, " ".join(["w"] * (1 + i % 50)), ["big", "big", "big", "mid", None][i % 5]) for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total)
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 64
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_mixing_odd_rows(spark):
    got = {r.doc_id: r for r in mixing.mix(rows(spark)).collect()}
    assert len(got) == len(ODD) and got[0].size == got[1].size == got[2].size == 0 == got[0].taken
    assert all(r.size == len(WORD.findall(ODD[i] or "")) for i, r in got.items())
    same = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], "doc_id long, text string, source string")
    assert len(mixing.mix(same).collect()) == 3


def test_the_schedule_orders_the_mix(spark, monkeypatch):
    """Every prefix of the mix is near the targets' shares, and other points give another order."""
    data = [(i, " ".join([f"w{i}"] * (1 + i % 30)), ["big", "big", "big", "mid", None][i % 5]) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing.mixed(df, block=64).collect()
    share = {r.source: r.target for r in mixing.mix(df, block=64).select("source", "target").distinct().collect()}
    whole = sum(share.values())
    seen, done = dict.fromkeys(share, 0), 0
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    for r in rows:
        seen[r.source] += r.size
        done += r.size
        if done >= 0.05 * whole:
            for s, n in seen.items():
                assert abs(n - done * share[s] / whole) <= 0.03 * whole, (s, n, done)
    assert done == pytest.approx(whole, rel=0.02)
    plain = mixing.mix(df, block=64).select("doc_id", "taken", "first_slot").collect()
    inner = mixing.schedule

    def in_turn(spark, by, block, slots):
        out = inner(spark, by, block, slots)
        return out.withColumn("slot", F.col("src") * 1_000_000 + F.col("k"))

    monkeypatch.setattr(mixing, "schedule", in_turn)
    other = mixing.mix(df, block=64).select("doc_id", "taken", "first_slot").collect()
    assert {(r.doc_id, r.taken) for r in plain} == {(r.doc_id, r.taken) for r in other}
    assert {(r.doc_id, r.first_slot) for r in plain} != {(r.doc_id, r.first_slot) for r in other}


FILLER = " ".join(f"filler{k}" for k in range(400))
TEXTS = [
    (None, 0, "", ""), ("CC BY-NC 4.0: licensed under CC BY-NC 4.0.", 2, "cc-by", "cc-by,cc-by-nc-4.0"), ("All rights\nreserved", 1, "reserved", "reserved"),
    ("Released under the\nMIT License", 0, "", "mit"), ("x Released under the MIT License x", 0, "", "mit"), ("ccby ccé by", 0, "", ""), ("cc by cc by", 2, "cc-by", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", 1, "gpl", "gpl,gpl-3.0"), ("Kall rights reserved", 0, "", ""),
    ("Licensed under CC BY 4.0", 1, "cc-by", "cc-by,cc-by-4.0"), ("Released under the BSD license", 0, "", "bsd"), ("Released under the Apache License", 0, "", ""),
    ("Licensed under the GNU General Public License version 2", 1, "gpl", "gpl,gpl-2.0"), ("Creative Commons Attribution 4.0", 0, "", "cc-by-4.0"), ("all reserved rights of others", 0, "", ""),
    ("Creative Commons Attribution-ShareAlike 4.0", 0, "", "cc-by-sa-4.0"), (f"{FILLER} released under {FILLER} the mit {FILLER} license", 0, "", ""),
    (f"{FILLER}\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n", 0, "", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", 0, "", "mpl-2.0"),
    *[(f"{FILLER}\n{t}\n{FILLER}", int("general public" in t.lower()) * t.lower().count("general public"), "gpl" if "general public" in t.lower() else "", n) for n, t, *_ in licenses.TEMPLATES if len(t) > 300],
]


def test_license_scan(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, *_) in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, (_, n, base, labels) in enumerate(TEXTS):
        r = got[i]
        if "K" in (TEXTS[i][0] or ""):  # the sign is no ASCII letter, so it belongs to the word
            assert r.n_base == 0
            continue
        labels = ",".join(sorted({*filter(None, (base or "").split(",")), *filter(None, labels.split(","))}))
        assert (r.n_base, r.base_labels, r.labels) == (n, base, labels), TEXTS[i]
        assert 0 <= r.score <= 1 and (r.first_word is None) == (n == 0)
    assert (got[6].first_word, got[6].last_word, got[6].n_words) == (0, 2, 4)


def plain(text):
    """Labels of every run of 2 W words that starts at a template's word, against every template."""
    w, out = licenses.tokens(text), set()
    for label, t, must, never in licenses.TEMPLATES:
        ws, width = set(licenses.tokens(t)), len(licenses.tokens(t))
        for k in (k for k, x in enumerate(w) if x in ws):
            b = w[k : k + 2 * width]
            held = all(any(f" {p} " in f" {' '.join(b)} " for p in g.split("|")) for g in must.split(";"))
            if 5 * len(set(b) & ws) >= 4 * len(ws) and held and not set(never.split()) & set(w[k : k + 3 * width]):
                out.add(label)
    return out


def test_templates_are_found_at_every_offset(spark):
    """Each template after any number of other words, up to twice its own, and before others."""
    rows, want = [], []
    for label, t, *_ in licenses.TEMPLATES:
        width = len(licenses.tokens(t))
        for k in range(0, 2 * width + 1, 1 if width < 20 else 7):
            rows.append((len(rows), " ".join(f"x{j}" for j in range(k)) + f" {t} " + "of the y " * 30))
            want.append(label)
    got = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [rows[i][1] for i, label in enumerate(want) if label not in got[i]] == []
    clause = [t for n, t, *_ in licenses.TEMPLATES if n == "bsd-3-clause"][0]
    assert all("bsd-2-clause" not in got[i] for i, label in enumerate(want) if label == "bsd-3-clause") and clause


DECIDED = [
    ("Licensed under the Apache License, Version 1.1, section 2 of 0 parts", set()),
    ("The MIT press holds the license under which it was released", set()),
    ("licensed under the GNU General Public License version 2 or version 3 of this work", {"gpl-2.0", "gpl-3.0"}),
    ("Open access. This article is licensed under CC BY 3.0 by its authors", {"cc-by-3.0"}),
    ("It is distributed under the terms of the Creative Commons Attribution 4.0 International License (CC BY 4.0)", {"cc-by-4.0"}),
    ("Licensed under the Apache License 2.0", {"apache-2.0"}),
    ("This file is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2.0"}),
]


def test_deciding_words_stand_together(spark):
    rows = [(i, " ".join(["lorem"] * k) + " " + t) for i, (t, _) in enumerate(DECIDED) for k in (0, 3, 11)]
    base = {"cc-by", "gpl", "reserved"}
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        assert {x for x in r.labels.split(",") if x} - base == DECIDED[r.doc_id][1], DECIDED[r.doc_id][0]


def test_filters_lose_no_template(spark):
    """Prefix, length and position filters against plain containment, over odd frequencies."""
    r, words = random.Random(4), licenses.vocabulary()
    short = [t for _, t, *_ in licenses.TEMPLATES if len(t) < 100]
    lines = [" ".join(r.choices(words, k=3) + r.sample(licenses.tokens(t), r.randint(max(1, len(licenses.tokens(t)) - 3), len(licenses.tokens(t)))) + r.choices(words, k=r.randint(0, 30))) for t in short for _ in range(12)]
    lines += [t for _, t, *_ in licenses.TEMPLATES] + [" ".join(r.choices(words, k=3000))]
    freq = {w: (k * 37) % 11 for k, w in enumerate(words)}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    for row in licenses.scanned(df, freq).collect():
        assert {x.label for x in row.found} == plain(lines[row.doc_id]), lines[row.doc_id]


def test_repeated_rows_are_scanned_alike(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License")] * 2 + [(2, "cc by " * 20_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_base, r.labels) for r in licenses.license_scan(df).collect())
    assert got == [(1, 0, "mit"), (1, 0, "mit"), (2, 20_000, "cc-by")]


@pytest.mark.parametrize("run", [quality.quality_rules, mixing.mix, licenses.license_scan])
def test_empty_tables_and_plans_without_python(spark, run):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    out = run(df)
    assert out.collect() == [] and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", out._jdf.queryExecution().executedPlan().toString())
