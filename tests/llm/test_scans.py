"""Line dedup, quality classifier, decontamination and licence scans."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarry.llm.decontam import find_contained, without_contaminated
from quarry.llm import licenses as L
from quarry.llm import linedup
from quarry.llm.licenses import match_rules, recognise, scan
from quarry.llm.linedup import dedup_lines
from quarry.llm.quality import _counted, fit, held_out, score_documents, train


def _key(line):
    return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(spark, keep):
    r = random.Random(3)
    pool = ["", "Menu", " menu\t", "É x", "é x", "Footer", "a", "A", " A", "line\r"] + [f"own {i}" for i in range(40)]
    rows = [(i, "\n".join(r.choices(pool, k=r.choice([1, 3, 10, 200])))) for i in range(60)] + [(100, None), (101, ""), (102, "\n"), (103, "menu\n" * 500)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    got = {x.doc_id: (x.text, x.n_lines, x.n_dropped, x.words) for x in dedup_lines(df.select("doc_id", "text"), 10, 1, keep).join(df.select("doc_id", "words"), "doc_id").collect()}
    holders, first = defaultdict(set), {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            holders[_key(line)].add(i)
            first.setdefault(_key(line), (i, p))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if not _key(x) or len(holders[_key(x)]) < 10 or (keep == "first" and first[_key(x)] == (i, p))]
        assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept), 1)


@pytest.mark.parametrize("limits", [None, 0])
def test_line_dedup_rows_that_share_ids(spark, monkeypatch, limits):
    if limits is not None:  # joins by shuffle
        monkeypatch.setattr(linedup, "BROADCAST_KEYS", limits)
        monkeypatch.setattr(linedup, "BROADCAST_WORDS", limits)
    rows = [(1, "menu\na"), (1, "menu\na"), (1, "b\nMenu"), (None, "menu"), (None, "x\nmenu"), (2, None), (3, "menu\n" * 70 + "end"), (4, "z " * 100_000 + "\nmenu")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, n_dropped int, words int, row int, t1 int")
    # under the ids 1, 3, 4 and none
    got = sorted(map(tuple, dedup_lines(df, 4).select("doc_id", "text", "n_lines", "n_dropped", "words", "row", "t1").collect()), key=str)
    assert got == sorted([(1, "a", 2, 1, 2, 3, 4), (1, "a", 2, 1, 2, 3, 4), (1, "b", 2, 1, 2, 3, 4), (None, "", 1, 1, 2, 3, 4), (None, "x", 2, 1, 2, 3, 4), (2, "", 1, 0, 2, 3, 4), (3, "end", 71, 70, 2, 3, 4), (4, "z " * 100_000, 2, 1, 2, 3, 4)], key=str)
    assert {x.n_dropped for x in dedup_lines(df, 5).collect()} == {0}
    first = sorted(((x.doc_id, x.text) for x in dedup_lines(df, 4, keep="first", counts=False).where("doc_id IS NULL").collect()), key=str)
    # rows without an id are one document; the first of them is that with the lesser hash of its text
    least = df.where("doc_id IS NULL").orderBy(F.xxhash64("text")).first()["text"]
    assert first == ([(None, "menu"), (None, "x")] if least == "menu" else [(None, ""), (None, "x\nmenu")])
    plain = dedup_lines(df, 4, counts=False)
    assert plain.columns == df.columns and {x.n_dropped for x in plain.collect()} == {1}


def test_line_dedup_copies_count_once(spark):
    rows = [(i, "head\nbody\nhead") for i in range(5, 15)] + [(20, "head\nx"), (21, "y\nhead")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in dedup_lines(df, 3, keep="first", copies="one").collect()}
    assert got == {i: "head\nbody" for i in range(5, 15)} | {20: "x", 21: "y"}
    assert {x.text for x in dedup_lines(df, 4, keep="first", copies="one").collect()} == {t for _, t in rows}


def test_line_dedup_no_tables(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in dedup_lines(df, 10).collect()} == {1: "a\nb", 2: "c"}


def test_classifier(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(r.randint(1, 60))) + "."
    bad = [lambda: " ".join(word() + r.choice(["###", "%%%"]) for _ in range(20)), lambda: " ".join([word()] * 30), lambda: " ".join(word().upper() + "!!" for _ in range(20))]
    rows = [(i, good() if i % 3 else bad[i % len(bad)](), 0.0) for i in range(900)] + [(5000, None, 1.0), (5001, "", 1.0), (None, "abc", 1.0), (1, "again", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(900)] + [(5000, None, ""), (None, 1, ""), (9999, 1, ""), (3, 0, "")], "doc_id long, quality int, text string")
    out = score_documents(docs, fit(docs, labels)).withColumn("held_out", held_out()).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    for x in out:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    test = [x for x in out if x.held_out and x.doc_id < 900 and x.text != "again"]
    assert sum((x.score >= 0.3) == (x.doc_id % 3 > 0) for x in test) >= 0.97 * len(test)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(empty, train([])).count() == 0
    assert {x.score for x in score_documents(docs, fit(empty, labels)).collect()} == {0.5}


@pytest.mark.parametrize("end", [[None], [""], ["a"], ["ab"], ["abc"], ["ok", None, ""], ["..."], [" . "]])
def test_classifier_batches_end_without_features(end):
    model = train([])
    model.out[:, 1] = 1
    column = pa.array(["some good words", "", "x", "more of them", *end])
    assert model.score(column).tolist() == pytest.approx([model.score(pa.array([x, "words after"], pa.string()))[0] for x in column.to_pylist()])
    assert len(list(_counted(pa.record_batch([column], ["text"]), 0))) == len(column)


def _contained(doc, item, k=5):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    d, w = words(doc), words(item)
    k = min(k, len(w))
    if not k:
        return None
    cut = lambda x: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
    a = cut(w)
    return len(a), len(a & cut(d))


def test_decontamination(spark):
    r = random.Random(7)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(150)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 4, 5, 6, 20, 45])))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (103, "W1 W2, w3; W4 w5 w6"), (None, "w1")]
    docs = []
    for n in range(150):
        text = r.choices(words, k=r.choice([0, 3, 30, 400]))
        if n % 2:
            own = (r.choice(items[:60])[1]).split()
            if n % 4 == 1 and len(own) > 10:
                own[r.randrange(len(own))] = "changed"
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((n, (" " if n % 3 else ",\n").join(text)))
    docs += [(900, None), (901, ""), (902, "x w1 w2 w3 W4 w5 w6 y")]
    d, b = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, n): c for i, t in items if i is not None for n, x in docs if (c := _contained(x, t)) and 100 * c[1] >= 80 * c[0]}
    assert {(x.item_id, x.doc_id): (x.n_shingles, x.n_found) for x in find_contained(d, b).collect()} == want and len(want) > 60
    assert {x.doc_id for x in without_contaminated(d, b).collect()} == {n for n, _ in docs} - {n for _, n in want}
    for none in (find_contained(d, b.limit(0)), find_contained(d.limit(0), b)):
        assert none.count() == 0
    assert without_contaminated(d, b.limit(0)).count() == len(docs)


MIT = """Copyright (c) 2019 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Some words.\nReleased under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "LicenseRef-All-Rights-Reserved"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n', ["Apache-2.0"]),
        ("# SPDX-License-Identifier: BSD-3-Clause\nx = 1", ["BSD-3-Clause"]),
        (MIT, ["MIT"]),
        (GPL, ["GPL-3.0-or-later"]),
        ("The licence of a driver was taken. Nothing else.", []),
        ("Released under the ISC License.", ["ISC"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", ["GPL-3.0"]),
        ("Licensed under the EUPL, Version 1.2 only.", ["EUPL-1.2"]),
        ("This file is distributed under the GNU Lesser General Public License v2.1 or later.", ["LGPL-2.1-or-later"]),
        ("The code is available under the terms of the GNU AGPL version 3.", ["AGPL-3.0-only"]),
        ("Made available under the terms of the Eclipse Public License v2.0.", ["EPL-2.0"]),
        ("Everything here is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nIf a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        ("It is under the new BSD license", ["BSD-3-Clause"]),
        ("/* SPDX-License-Identifier: ((GPL-2.0-only WITH Linux-syscall-note) OR bsd-2-clause) */", ["GPL-2.0-only WITH Linux-syscall-note", "BSD-2-Clause"]),
        ("# SPDX-License-Identifier: LicenseRef-Own", ["LicenseRef-Own"]),
        ("SPDX license identifier GPL 2.0 or later AND MIT", ["GPL-2.0-or-later", "MIT"]),
        ("", []),
    ],
)
def test_licences(text, want):
    assert match_rules(recognise(text)) == want


@pytest.mark.parametrize(
    ("above", "want"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only)", ["Apache-2.0", "GPL-2.0-only", "MIT"]),
        ("SPDX License Identifier MIT", ["MIT"]),
        ("All rights reserved", ["LicenseRef-All-Rights-Reserved", "MIT"]),
        ("Copyright (c) 2020 Foo\nAll rights reserved", ["LicenseRef-All-Rights-Reserved", "MIT"]),
        ("Copyright (c) 2020 Foo", ["MIT"]),
    ],
)
def test_line_above_wrapped_notice(above, want):
    notice = MIT.split("\n\n", 1)[1]
    for text in (f"{above}\n{notice}", f"{above}\n{notice.replace('\n\n', '\n')}"):
        found = recognise(text)
        assert match_rules(found) == want
        assert [n for n, _ in found][-3:] == ["mit_grant", "mit_notice", "mit_as_is"]
        assert ("SPDX" in above) == (found[0][0] == "spdx")


def test_scan(spark):
    rows = [(1, "x\nAll rights reserved.", 0), (2, None, 0), (3, "", 0), (None, "Released under the MIT License.", 0), (1, "y " * 50_000 + "\nLicensed under CC BY-NC 4.0.", 0)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, licenses int")).collect()
    assert [(x.doc_id, list(x.licenses)) for x in got] == [(1, ["LicenseRef-All-Rights-Reserved"]), (2, []), (3, []), (None, ["MIT"]), (1, ["CC-BY-NC-4.0"])]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _shortest(parsed):
    """Texts that a pattern matches: every alternative, nothing where something is optional."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg)]
        elif name == "IN":
            part = [next(chr(c) for c in range(48, 128) if re.fullmatch(r"[0-9a-z]", chr(c)) and any(str(o) == "RANGE" and v[0] <= c <= v[1] or str(o) == "LITERAL" and v == c for o, v in arg))]
        elif name == "ANY":
            part = ["x"]
        elif name == "SUBPATTERN":
            part = _shortest(arg[3])
        elif name == "BRANCH":
            part = [x for a in arg[1] for x in _shortest(a)]
        else:
            assert name == "MAX_REPEAT", name
            part = [x * arg[0] for x in _shortest(arg[2])] if arg[0] else [""]
        out = list(dict.fromkeys(a + b for a in out for b in part))
    return out


@pytest.mark.parametrize(("name", "pattern"), L.SENTENCES)
def test_no_known_sentence_is_left_out_beforehand(name, pattern):
    found = _shortest(re._parser.parse(pattern))
    assert found
    for s in found:
        assert re.fullmatch(pattern, s), s
        for text in (s, s.upper(), s.replace(" ", "\n"), s.replace(" ", "-"), s.replace(" ", " \n * ")):
            assert pc.match_substring_regex(pa.array([text]), L.CRITICAL, ignore_case=True)[0].as_py() and L._CRITICAL.search(text.lower()), text


def test_scan_leaves_no_licence_out(spark):
    texts = ["Text is available under CC BY-SA 4.0", "This work is distributed under Creative Commons Attribution 4.0 International.", "The data is in the public\ndomain", "It is in the public-domain.", "All rights\nreserved"]
    want = ["CC-BY-SA-4.0", "CC-BY-4.0", "LicenseRef-Public-Domain", "LicenseRef-Public-Domain", "LicenseRef-All-Rights-Reserved"]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [list(x.licenses) for x in sorted(got)] == [[x] for x in want]


def test_every_name_is_found():
    texts = []
    for name, (want, _) in sorted(L.NAMES.items()):
        for text in (f"Some words. This work is licensed under the {name}.", f"x\n * Released under {name.upper()}\n", f"It is available under the terms of the\n{name.replace(' ', '-')}"):
            assert match_rules(recognise(text)) == [f"{want}-only" if re.match("A?L?GPL-|GFDL-", want) else want], text
            texts.append(text)
    assert all(pc.match_substring_regex(pa.array(texts), L.CRITICAL, ignore_case=True).to_pylist())


def test_scan_equals_recognition_without_gate(spark, monkeypatch):
    r = random.Random(2)
    parts = [MIT, GPL, "Released under the ISC License.", "x", "word " * 40, "All rights reserved.", "SPDX-License-Identifier: MIT", "Text under CC BY 4.0.", "the gpl", "(c) 2020", "A license to go.", "Apache 2.0", "Licensed under the EUPL v1.2"]
    rows = [(i, "\n".join(r.choices(parts, k=r.choice([0, 1, 2, 6]))).replace(" ", r.choice([" ", " ", "\n", "-"]))) for i in range(300)]
    got = {x.doc_id: (list(x.licenses), list(x.sentences)) for x in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(L, "_CRITICAL", re.compile(""))
    want = {i: recognise(t) for i, t in rows}
    assert got == {i: (match_rules(x), [n for n, _ in x]) for i, x in want.items()}


def test_decontamination_rows_that_share_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, "clean"), (None, item), (None, None), (2, "w " * 200_000 + item), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(3, item), (3, item), (None, "clean")], "item_id long, text string")
    assert sorted(map(str, (x.doc_id for x in find_contained(docs, items).collect()))) == ["1", "1", "2", "2", "None", "None"]
    assert sorted(((x.doc_id, x.text) for x in without_contaminated(docs, items).collect()), key=str) == [(1, "clean"), (2, ""), (None, None)]


def test_sketches_need_no_luck():
    from quarry.llm.decontam import Sketches

    s = Sketches([(i, " ".join(f"a{i}b{j}" for j in range(5, 5 + i))) for i in range(1, 80)], 5, 80)
    for p in s.partitions:
        sizes = np.bincount(p.owners)
        for i in np.unique(p.owners):
            n = len(s.shingles[i])
            assert p.least <= n < 2 * p.least and sizes[i] >= min(n, n - -(-80 * n // 100) + 1)


def test_a_very_long_text_holds_what_stands_at_its_end(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    rows = [(1, "w " * 300_000 + item, "a", 1), (2, " ".join(f"v{i}" for i in range(100_000)), "b", 2), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, n_found int")
    items = spark.createDataFrame([(7, item, 5), (8, "v99990 v99991 v99992 v99993 v99994 v99995", 5)], "item_id long, text string, doc_id int")
    got = sorted((x.item_id, x.doc_id, x.n_shingles, x.n_found, x.containment) for x in find_contained(docs, items).collect())
    assert got == [(7, 1, 3, 3, 1.0), (8, 2, 2, 2, 1.0)]
    assert find_contained(docs, items.limit(0)).count() == 0 and find_contained(docs.limit(0), items).count() == 0


def test_scan_reads_a_very_long_text_to_its_end(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(1, "plain words. " * 50_000 + notice, "x"), (2, "", "y")], "doc_id long, text string, licenses string")
    got = {x.doc_id: list(x.licenses) for x in scan(docs).collect()}
    assert got == {1: ["Apache-2.0"], 2: []}
    assert scan(docs.limit(0)).count() == 0


def test_classifier_without_tables(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    for d, y in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        assert {x.score for x in score_documents(docs, fit(d, y)).collect()} == {0.5}
