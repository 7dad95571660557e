"""Licence scans: dual notices, negation, names within other words, cut and wrapped texts, and sequences against a plain matcher."""

import itertools
import random
import textwrap

import pytest

from quarry.llm import licenses as L

CASES = {
    "Licensed under the MIT License or the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
    "Licensed under either the Apache License, Version 2.0 or the MIT license, at your option.": ["Apache-2.0", "MIT"],
    "Released under the MIT License and the GNU General Public License version 2 or later.": ["MIT", "GPL-2.0-or-later"],
    "This is available under the GPL v3 or the MPL 2.0.": ["GPL-3.0-only", "MPL-2.0"],
    "This file is not licensed under the MIT License.": [],
    "It was never released under the GPL.": [],
    "The code isn't available under the Apache License 2.0.": [],
    "This work is not released into the public domain.": [],
    "This work is released into the public domain.": ["LicenseRef-Public-Domain"],
    "The shipment id CC0 was late.": [],
    "This data is available under CC0.": ["CC0-1.0"],
    "CC0 1.0 Universal": ["CC0-1.0"],
    "To the extent possible this is dedicated to the public domain.": ["CC0-1.0"],
    "Licensed under the MIT License.": ["MIT"],
}

TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "Apache-2.0": """2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    "GPL-3.0": """The GNU General Public License is a free, copyleft license for software and other kinds of works.

The licenses for most software and other practical works are designed to take away your freedom to share and change the works.""",
    "GPL-2.0": "The licenses for most software are designed to take away your freedom to share and change it.",
    "HPND": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.""",
}


@pytest.mark.parametrize("text", CASES)
def test_notices(text):
    assert L.match_rules(L.recognise(text)) == CASES[text]
    assert L.match_rules(L.recognise(f"Some words before it.\n\n// {text}\n\nAnd some after.")) == CASES[text]


@pytest.mark.parametrize("name", TEXTS)
def test_whole_wrapped_and_cut_texts(name):
    text = TEXTS[name]
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 60)) for p in text.split("\n\n"))
    commented = "\n".join(f" * {line}".rstrip() for line in wrapped.split("\n"))
    paragraphs = text.split("\n\n")
    for variant in (text, wrapped, commented, text.upper(), "Copyright (c) 2020 A\n\n" + text):
        assert L.match_rules(L.recognise(variant)) == [name], variant[:60]
    if len(paragraphs) > 2:
        assert L.match_rules(L.recognise("\n\n".join(paragraphs[1:]))) == [name]
    if len(paragraphs) > 1:
        last_cut = L.match_rules(L.recognise("\n\n".join(paragraphs[:-1])))
        assert last_cut == [name]


def brute_rules(found):
    """Rules one after the other at each place, with an explicit mark of what is used."""
    items = [x for x in found if x[0] != "copyright"]
    used, got = [False] * len(items), []
    for licence, sequence in L.RULES:
        at = 0
        while at < len(items):
            free = [i for i in range(at, len(items)) if not used[i]][: len(sequence)]
            if len(free) < len(sequence):
                break
            if all(want == items[i][0] or want == f"{items[i][0]}={items[i][1]}" for want, i in zip(sequence, free, strict=True)):
                for i in free:
                    used[i] = True
                for n, name in enumerate(licence.format(items[free[0]][1]).split(",")):
                    got.append((free[0], n, name))
            at = free[0] + 1
    return list(dict.fromkeys(name for *_, name in sorted(got)))


def test_rules_against_a_plain_matcher():
    r = random.Random(6)
    kinds = sorted({w.split("=")[0] for _, s in L.RULES for w in s} | {"copyright"})
    detail = {"named": ["MIT", "ISC", "Apache-2.0", "GPL-3.0", "MIT,ISC"], "spdx": ["MIT", "ISC,BSD"], "gnu_free": ["GPL-2.0-only"], "mpl_name": ["MPL-2.0"]}
    for _ in range(3000):
        if r.random() < 0.5:
            parts = [list(r.choice(L.RULES)[1]) for _ in range(r.randrange(1, 4))]
            names = [w for p in parts for w in p if r.random() < 0.9]
        else:
            names = [r.choice(kinds) for _ in range(r.randrange(8))]
        found = [tuple(w.split("=")) if "=" in w else (w, r.choice(detail.get(w, [""]))) for w in names]
        assert L.match_rules(found) == brute_rules(found), found


def test_every_sentence_and_name_passes_the_gate():
    for name in itertools.islice(L.NAMES, 0, None, 7):
        assert L._CRITICAL.search(f"licensed under the {name}")
    for text in TEXTS.values():
        for paragraph in text.lower().split("\n\n"):
            assert L._CRITICAL.search(paragraph)
