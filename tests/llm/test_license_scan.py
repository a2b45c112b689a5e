import pytest

from storyloom.llm import license_scan as L

CORPUS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{CORPUS}/documents.parquet"))


# The notices that the tables hold.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "all-rights-reserved",
}


def test_families_of_known_and_changed_notices(spark, model):
    texts = [*NOTICES, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met."]
    rows = [(i, f"Some words here.\n\n{t}\nmore text") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].family, got[i].paragraph, got[i].text) == ([*NOTICES.values(), "mit", "bsd"][i], 2, t)


def test_every_notice_of_the_corpus_and_nothing_else(spark, model):
    docs = spark.read.parquet(f"{CORPUS}/documents.parquet")
    want = {(r.doc_id, k, NOTICES[line]) for r in docs.collect() for k, line in enumerate(r.text.split("\n")) if line in NOTICES}
    got = [(r.doc_id, r.paragraph, r.family) for r in L.scan(docs, model).collect()]
    assert len(want) > 20 and want <= set(got)
    assert len(got) - len(want) <= 0.02 * len(want) + 1


def test_edges(spark, model):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "words " * 30000 + "\n" + notice), (5, notice), (5, notice), (None, notice)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 family"), model).collect()
    assert sorted((r.doc_id or 0, r.paragraph) for r in got if r.family == "mit") == [(0, 0), (4, 1), (5, 0), (5, 0)]
    odd = L.scan(spark.createDataFrame([(9, "Licensed under the Frobnicate Community License, version 7, terms of use.")], "doc_id long, text string"), model).collect()
    assert all(r.family == "unknown" for r in odd)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(empty, L.fit(empty, rounds=1)).count() == 0
    assert "temperature" in L.describe(model)


# Notices in other words than the templates', and wrapped ones.
HELD_OUT = {
    "apache-2.0": ["The code in this repository is available under the Apache License, Version 2.0.", "Distributed under the Apache License 2.0; see the file LICENSE for details.", "Licensed to you under the Apache License, Version 2.0."],
    "mit": ["This library is released under the MIT License, see LICENSE.", "Code is licensed under the MIT license.", "Distributed under the terms of the MIT License.", "MIT License"],
    "gpl-3.0": ["This software is released under the GNU General Public License version 3 or later.", "Licensed under the terms of the GNU General Public License, version 3."],
    "gpl-2.0": ["This module is licensed under the GNU General Public License, version 2."],
    "lgpl": ["You may use this library under the terms of the GNU Lesser General Public License.", "Released under the GNU Lesser General Public License, version 2.1."],
    "bsd": ["Use of this code is governed by a BSD-style license.", "Released under the BSD 3-Clause license, see the file.", "Redistribution and use in source and binary forms are permitted provided that these conditions are met."],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0."],
    "cc-by-sa": ["Content is available under the Creative Commons Attribution-ShareAlike 4.0 License.", "Photos are licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Images are licensed under CC BY-NC 4.0."],
    "public-domain": ["This code is released into the public domain.", "The author has waived all copyright to this work under CC0 1.0."],
    "all-rights-reserved": ["Copyright 2021 Example Press. All rights reserved.", "No part of this book may be reproduced without the written permission of the publisher."],
}


def test_held_out_notices_are_found(spark, model):
    rows = [(f, t) for f, ts in HELD_OUT.items() for t in ts]
    known = {t for ts in L.TEMPLATES.values() for t in ts}
    assert not known & {t for _, t in rows}
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(i, f"Prose of no note stands here.\n\n{t}\n\nMore of it.") for i, (_, t) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    right = [f for i, (f, _) in enumerate(rows) if i in got and got[i].family == f]
    assert len(right) >= 0.9 * len(rows), [t for i, (f, t) in enumerate(rows) if i not in got or got[i].family != f]


@pytest.mark.parametrize("alone", [True, False])
def test_a_wrapped_notice_is_one_hit(spark, model, alone):
    import textwrap

    whole = {"mit": " ".join(L.TEMPLATES["mit"][4:]), "gpl-2.0": L.TEMPLATES["gpl-2.0"][1], "bsd": " ".join(L.TEMPLATES["bsd"][2:5])}
    for width in (50, 72):
        rows = [(i, "Eight words of prose stand here before it\n" + "\n" * alone + textwrap.fill(t, width) + "\n" * alone + "\nand nine more words of prose stand after it") for i, t in enumerate(whole.values())]
        got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
        for i, (family, t) in enumerate(whole.items()):
            mine = [r for r in got if r.doc_id == i and r.family == family]
            assert sum(len(r.text) for r in mine) >= 0.85 * len(t) and len(mine) <= 2
            assert all(r.text == "\n".join(rows[i][1].split("\n")[r.paragraph : r.paragraph + r.lines]) for r in mine)


def test_scores_against_brute_force(spark, model):
    """Each line scored by itself, word by word, gives the hits' probabilities."""
    docs = spark.read.parquet(f"{CORPUS}/documents.parquet").limit(300)
    got = {(r.doc_id, r.paragraph): r for r in L.scan(docs, model).collect() if r.lines == 1}
    last = len(L.FAMILIES)
    for r in docs.collect():
        lines = r.text.split("\n")
        p = L.classify(lines, model)
        for k, line in enumerate(lines):
            if (r.doc_id, k) in got:
                hit = got[r.doc_id, k]
                assert hit.text == line and abs(hit.probability - p[k, :last].max()) < 1e-4
            elif p[k, last] < 0.49 and L._pairs(line) & set().union(*L._family_pairs().values()):
                raise AssertionError((r.doc_id, k, line))


def test_families_that_tie(spark):
    flat = L.Model(L.np.zeros((1 << L.BITS, len(L.FAMILIES) + 1), L.np.float32), L.np.array([2.0] * len(L.FAMILIES) + [-9.0], L.np.float32), 1.0)
    got = L.scan(spark.createDataFrame([(1, "the software"), (1, "the software")], "doc_id long, text string"), flat, sure=0.0, alike=0.0).collect()
    assert [r.family for r in got] == [L.FAMILIES[0]] * 2


# Notices that are like those of another family but for a word or a number.
LOOK_ALIKES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 or later.": "agpl-3.0",
    "You should have received a copy of the GNU Affero General Public License along with this software.": "agpl-3.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl-3.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "gpl-2.0",
    "GNU General Public License version 3": "gpl-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "unknown",
    "Licensed under CC BY-ND 4.0.": "unknown",
    "Licensed under the Apache License, Version 1.1.": "unknown",
    "Licensed under the Mozilla Public License, version 1.1.": "unknown",
    "Licensed under the GNU General Public License, version 1.": "unknown",
    "Distributed under the Boost Software License, Version 1.0.": "unknown",
    "This program is licensed under the Eclipse Public License, version 2.0.": "unknown",
}


def test_look_alike_families(spark, model):
    """Recall and precision of 0.9 on notices that differ from another family's in a deciding word or version."""
    rows = list(LOOK_ALIKES.items())
    got = {}
    for r in L.scan(spark.createDataFrame([(i, f"Prose of no note stands here.\n\n{t}\n\nMore of it.") for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append(r.family)
    told = [(f, [x for x in got.get(i, []) if x != "unknown"]) for i, (_, f) in enumerate(rows)]
    known = [(f, x) for f, x in told if f != "unknown"]
    assert sum(f in x for f, x in known) >= 0.9 * len(known), [(rows[i][0], got.get(i)) for i in range(len(rows))]
    found = [(f, x) for f, xs in told for x in xs]
    assert sum(f == x for f, x in found) >= 0.9 * len(found), found


def test_contradictions():
    assert L.contradicted("the GNU Affero General Public License, version 3", "gpl-3.0") and not L.contradicted("the GNU Affero General Public License, version 3", "agpl-3.0")
    assert L.contradicted("GNU General Public License version 3", "gpl-2.0") and not L.contradicted("GNU General Public License", "gpl-2.0")
    assert not L.contradicted("Apache License 2.0", "apache-2.0") and L.contradicted("Apache License, Version 1.1", "apache-2.0")
