"""Licence scans by sentence and rule recognition.

A text is split into sentences; each is normalised and, if it is a known one, mapped to its identifier: a sentence of a licence's text
by the table ``SENTENCES``, one that says under which licence something stands, or that is a licence's title, by looking the name up in
the table ``NAMES``. The text's sequence of identifiers is then matched against ordered rules: the first rule that fits at a place, longer ones
standing first, names the licence and uses its sentences up; the others may complete further rules. SPDX expressions give
each of their licences, spelt as published.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import split_batches, texts

#: Names of licences: spellings as normalising leaves them, versions, and the published id, with the version in place of ``{}``. A
#: version may follow as ``2.0``, ``2``, ``v2.0``, ``v 2.0`` or ``version 2.0``.
_NAMES: list[tuple[tuple[str, ...], tuple[str, ...], str]] = [
    (("mit license", "mit licence", "expat license", "mit x11 license"), (), "MIT"),
    (("isc license", "isc licence"), (), "ISC"),
    (("bsd license", "bsd licence", "bsd style license"), (), "BSD"),
    (("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"), (), "BSD-2-Clause"),
    (("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"), (), "BSD-3-Clause"),
    (("bsd 4 clause license", "4 clause bsd license", "original bsd license", "bsd 4 clause"), (), "BSD-4-Clause"),
    (("apache license", "apache software license", "apache"), ("2.0", "1.1"), "Apache-{}"),
    (("mozilla public license", "mozilla public licence", "mpl"), ("2.0", "1.1"), "MPL-{}"),
    (("eclipse public license", "epl"), ("2.0", "1.0"), "EPL-{}"),
    (("european union public licence", "european union public license", "eupl"), ("1.2", "1.1", "1.0"), "EUPL-{}"),
    (("boost software license",), ("1.0",), "BSL-{}"),
    (("artistic license",), ("2.0", "1.0"), "Artistic-{}"),
    (("open database license", "odbl"), ("1.0",), "ODbL-{}"),
    (("sil open font license", "ofl"), ("1.1", "1.0"), "OFL-{}"),
    (("common development and distribution license", "cddl"), ("1.1", "1.0"), "CDDL-{}"),
    (("academic free license",), ("3.0", "2.1"), "AFL-{}"),
    (("microsoft public license",), (), "MS-PL"),
    (("zlib license", "zlib libpng license"), (), "Zlib"),
    (("unlicense", "the unlicense"), (), "Unlicense"),
    (("wtfpl", "do what the fuck you want to public license"), (), "WTFPL"),
    (("python software foundation license",), (), "PSF-2.0"),
    (("cc0 1.0 universal", "cc0 1.0", "cc0"), (), "CC0-1.0"),
    (("gnu general public license", "gnu general public licence", "general public license", "gnu gpl", "gpl"), ("3.0", "2.0", "1.0"), "GPL-{}"),
    (("gnu lesser general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("3.0", "2.1"), "LGPL-{}"),
    (("gnu library general public license", "library general public license"), ("2.0",), "LGPL-{}"),
    (("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("3.0", "1.0"), "AGPL-{}"),
    (("gnu free documentation license", "gfdl"), ("1.3", "1.2", "1.1"), "GFDL-{}"),
    *(
        ((f"cc {c}", f"cc {c} license", f"creative commons {c}", f"creative commons {w}", f"creative commons {w} license"), ("4.0", "3.0", "2.5", "2.0", "1.0"), f"CC-{c.upper().replace(' ', '-')}-{{}}")
        for c, w in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
    ),
]


def _spelt() -> dict[str, tuple[str, bool]]:
    """Normalised name to (id, whether it has a version): every spelling with and without each version."""
    out: dict[str, tuple[str, bool]] = {}
    for spellings, versions, name in _NAMES:
        for x in spellings:
            out.setdefault(x, (name.replace("-{}", ""), not versions))
            for v in versions:
                short = (v, v.removesuffix(".0")) if v.endswith(".0") else (v,)
                tails = [f"{w}{n}" for n in short for w in ("", "v", "v ", "version ", "international ", "unported ")]
                for t in [*tails, *(f"{n} {w}" for n in short for w in ("international", "unported", "generic", "license"))]:
                    out.setdefault(f"{x} {t}", (name.format(v), True))
    return out


#: Normalised name of a licence to its id.
NAMES = _spelt()
_LONGEST = max(len(x.split()) for x in NAMES)
#: How a sentence says that a licence follows.
_UNDER = re.compile(r"(?:^| )(?:licen[cs]ed|released|distributed|redistributed|available|provided|published|offered|covered|governed|free|put|is|are) (?:by|under|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?(?=\S)")
#: Ids as published, also of what only SPDX expressions name.
_PUBLISHED = {x.lower(): x for x in (
    *(x for x, _ in NAMES.values()), *(f"{x}-{y}" for x, _ in NAMES.values() if re.match("A?L?GPL-[0-9]|GFDL-[0-9]", x) for y in ("only", "or-later")),
    "0BSD", "BlueOak-1.0.0", "Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "NCSA", "OpenSSL", "PostgreSQL", "X11", "curl", "Ruby", "Python-2.0", "NONE", "NOASSERTION",
)}

# a licence id as normalising leaves it
_ID = r"[a-z0-9.+]+(?: (?:v?[0-9][0-9.+]*|clause|only|or later|license|patent|by|nc|sa|nd|exception))*"
#: Known sentences: identifier, and a pattern of the whole normalised sentence (lower case, words and numbers with dots, single spaces).
SENTENCES: list[tuple[str, str]] = [
    ("spdx", rf"spdx license identifier (?P<id>{_ID}(?: (?:and|or|with) {_ID})*)"),
    ("copyright", r"(?:portions )?copyright (?:c )?[0-9].*|(?:portions )?copyright c .*"),
    ("all_rights_reserved", r"(?:.* )?all rights reserved"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit0_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit_notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit_liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd_grant", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notices? appears? in all copies(?: and that both that copyright notices? and this permission notice appear in supporting documentation)?.*"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("isc_as_is", r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd_redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_advertising", r"(?:3 )?all advertising materials mentioning features or use of this software must display the following acknowledgement.*"),
    ("bsd_endorse", r"(?:[34] )?neither the names? of .* nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_as_is", r"this software is provided by .* as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache_compliance", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at.*"),
    ("apache_as_is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache_grant", r"(?:(?:2 )?grant of copyright license )?subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache_patent", r"(?:(?:3 )?grant of patent license )?subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license to make have made use offer to sell sell import and otherwise transfer the work.*"),
    ("gpl2_preamble", r"(?:preamble )?the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl3_preamble", r"(?:preamble )?the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl3_freedom", r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gnu_free", r"(?:.* )?(?:is free software )?you can redistribute it and or modify it under the terms of (?:version (?P<id>[0-9.]+) of )?the gnu (?P<id2>lesser |library |affero )?general public license(?: version (?P<id3>[0-9.]+)| v(?P<id4>[0-9.]+))?(?P<id5> only)? as published by the free software foundation(?P<id6>.* version [0-9.]+.*)?"),
    ("gnu_warranty", r"(?:.* )?is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu_copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license.*"),
    ("mpl_name", r"this source code form is subject to the terms of the mozilla public license v (?P<id>[0-9.]+)"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("cc0_name", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?|(?:.* )?(?P<said>(?:creative commons )?cc0 (?:1\.0|licen[cs]e|universal|public domain|dedication|waiver)|(?:under|to|with|using|by) (?:the )?(?:terms of )?(?:the )?(?:creative commons )?cc0|dedicated to the public domain)(?: .*)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public_domain", r"(?:.* )?(?P<said>(?:is|are|released|placed) (?:in|into|to) the public domain)(?: .*)?"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

#: Rules in the order in which they are tried: licence, and the identifiers in sequence. ``{}`` is what the first sentence tells; ``named=MIT`` is
#: a sentence that names just that.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("named=MIT", "mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("named=MIT", "mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT-0", ("mit0_grant", "mit_as_is", "mit_liability")),
    ("MIT-0", ("mit0_grant", "mit_as_is")),
    ("MIT-0", ("mit0_grant",)),
    ("MIT", ("mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("named=MIT", "mit_grant", "mit_notice")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("named=MIT", "mit_grant")),
    ("MIT", ("mit_grant",)),
    ("BSD-4-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-4-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse")),
    ("BSD-4-Clause", ("bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_source", "bsd_binary", "bsd_as_is")),
    ("Apache-2.0", ("named=Apache-2.0", "apache_compliance", "apache_copy", "apache_as_is")),
    ("Apache-2.0", ("named=Apache-2.0", "apache_compliance", "apache_copy")),
    ("{}", ("gnu_free", "gnu_warranty", "gnu_copy")),
    ("{}", ("gnu_free", "gnu_warranty")),
    ("{}", ("mpl_name", "mpl_copy")),
    ("ISC", ("named=ISC", "isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("named=ISC", "isc_grant")),
    ("ISC", ("isc_grant",)),
    ("HPND", ("hpnd_grant",)),
    ("BSL-1.0", ("named=BSL-1.0", "boost_grant")),
    ("BSL-1.0", ("boost_grant",)),
    ("Apache-2.0", ("named=Apache-2.0", "apache_grant", "apache_patent")),
    ("Apache-2.0", ("apache_grant", "apache_patent")),
    ("Apache-2.0", ("apache_grant",)),
    ("Apache-2.0", ("apache_patent",)),
    ("GPL-3.0", ("named=GPL-3.0", "gpl3_preamble", "gpl3_freedom")),
    ("GPL-3.0", ("gpl3_preamble", "gpl3_freedom")),
    ("GPL-3.0", ("gpl3_preamble",)),
    ("GPL-3.0", ("gpl3_freedom",)),
    ("GPL-2.0", ("named=GPL-2.0", "gpl2_preamble")),
    ("GPL-2.0", ("gpl2_preamble",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("{}", ("spdx",)),
    ("{}", ("gnu_free",)),
    ("{}", ("mpl_name",)),
    ("{}", ("named",)),
    ("CC0-1.0", ("cc0_name",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-Public-Domain", ("public_domain",)),
    ("LicenseRef-All-Rights-Reserved", ("all_rights_reserved",)),
]

#: Every sentence of ``SENTENCES`` holds one of these, and every name the first two words of one in ``NAMES``, in any case; a text without them is not split. Between two words may stand what normalising
#: turns into a space: signs, line breaks with comment signs, letters beyond ASCII.
CRITICAL = "|".join(
    [r"licen[cs]e|copyright|rights reserved|permission|redistribut|warrant|public domain|as is|liable|compliance|cc0|endorse|advertising materials|hope that|copy of the|free software"]
    + sorted({re.escape(" ".join(x.split()[:2])).replace("\\ ", " ") for x in NAMES if "licen" not in x})
).replace(" ", "(?-i:[^A-Za-z0-9]+)")

#: What before the words that a licence follows takes them back, with up to two words between.
_NOT = re.compile(r"(?:^| )(?:not|never|neither|nor|no longer|cannot|isn t|aren t|wasn t|weren t)(?: [a-z]+){0,2}$")
#: What stands between two names in one sentence.
_ALSO = re.compile(r"(?:and or|or|and|as well as)(?: (?:under|alternatively|optionally|also|at your option))*(?: (?:the )?terms of)?(?: (?:the|a|an))? (?=\S)")
_BREAK = re.compile(r"\n+|(?<=[.;:!?])(?<![ ,][vV]\.)[ \t]+(?=[^a-z\s])|(?<=[;:!?])\s+")
_NOT_WORD = re.compile(r"(?<![0-9])\.|\.(?![0-9])|[^a-z0-9.,+]+|,")
_TAG = re.compile(r"(?i)spdx-license-identifier:\s*[( \t]*([A-Z0-9.+:/-]+(?:[) \t]+(?:AND|OR|WITH)[ \t(]+[A-Z0-9.+:/-]+)*)")
_WRAP = re.compile(r"\s*\n[^\w\n(\"']*")
_SPACES = re.compile(r" +")
_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_CRITICAL = re.compile(CRITICAL)


def normalise(sentence: str) -> str:
    """Lower case; words and numbers with inner dots, one space between; everything else goes."""
    return _SPACES.sub(" ", _NOT_WORD.sub(" ", sentence.lower())).strip()


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """Normalised sentences with their first and last place. A sentence ends at a line break or after a mark; comment signs vanish in normalising.

    A licence text wrapped over lines is met by joining a block of successive lines as well, see :func:`recognise`.
    """
    first = 0
    for last, after in (*(m.span() for m in _BREAK.finditer(text)), (len(text), 0)):
        s = normalise(text[first:last])
        if s:
            yield first, last, s
        first = after


def _name_at(words: list[str]) -> tuple[str, list[str]] | None:
    """The id of the longest name with which the words begin, and the words after it."""
    for n in range(min(_LONGEST, len(words)), 0, -1):
        if (found := NAMES.get(" ".join(words[:n]))) is not None:
            return found[0], words[n:]
    return None


def _version(name: str, tail: str, title: bool) -> tuple[str, str]:
    """The id of a GNU name with what its tail tells of version and later ones, and the tail behind a version."""
    if re.match("A?L?GPL|GFDL", name):
        if "-" not in name and (m := re.match(r"(?:gpl |lgpl |agpl )?(?:version |v )?v?([0-9][0-9.]*) ?", tail)):
            name, tail = f"{name}-{m[1].rstrip('.')}" + ".0" * ("." not in m[1].rstrip(".")), tail[m.end() :]
        if "-" in name and not title:
            name += "-or-later" if re.search(r"(?:^| )or (?:any |at your option any )?(?:later|newer)", tail) else "-only"
    return name, tail


def _named(s: str) -> tuple[str, str] | None:
    """A sentence that says under which licences something stands, or is no more than a licence's title, perhaps with its date.

    Names that follow the first by "or" and "and" count as well; a sentence that says that something doesn't stand under them names none.
    """
    for before, start, title in (*((m.start(), m.end(), False) for m in _UNDER.finditer(s)), (0, 0, True)):
        if _NOT.search(s[:before]) or re.match(r" ?(?:is|are) not ", s[before:start]):
            continue
        words = s[start:].split()
        words = words[1:] if words[:1] in (["the"], ["either"]) else words
        found = _name_at(words[1:] if words[:1] == ["the"] else words)
        if found is None:
            continue
        name, rest = found
        tail = " ".join(rest)
        if title and not re.fullmatch(r"(?:(?:the )?license|(?:[0-9]{1,2} )?(?:january|june|november|february|august|october|may) [0-9]{4}|gpl|lgpl|agpl)?", tail):
            continue
        name, tail = _version(name, tail, title)
        names = [name]
        while not title and (m := _ALSO.match(tail)) and (found := _name_at(tail[m.end() :].split())) is not None:
            name, tail = _version(found[0], " ".join(found[1]), False)
            names.append(name)
        return "named", ",".join(dict.fromkeys(names))
    return None


def _identify(s: str) -> tuple[str, str] | None:
    if not _CRITICAL.search(s):
        return None
    for name, pattern in _KNOWN:
        if m := pattern.fullmatch(s):
            if "said" in m.re.groupindex and m["said"] and _NOT.search(s[: max(0, m.start("said") - 1)]):
                continue
            return name, _detail(name, m)
    return _named(s)


def spdx_ids(expression: str) -> str:
    """The licences of an SPDX expression, spelt as published and joined by a comma, each once; an exception stays with its licence."""
    out = []
    for part in re.split(r"(?i)(?:^|[()\s]+)(?:AND|OR)[()\s]+", expression.strip("() \t")):
        words = [x for x in re.split(r"[()\s]+", part) if x]
        out.append(" ".join("WITH" if x.upper() == "WITH" else _PUBLISHED.get(x.lower(), x) for x in words))
    return ",".join(dict.fromkeys(x for x in out if x))


def _detail(name: str, m: re.Match) -> str:
    g = {k: (v or "").strip() for k, v in m.groupdict().items()}
    if name == "spdx":  # dashes are gone
        return spdx_ids(re.sub(r"\x00| ", lambda x: " " if x[0] == "\0" else "-", re.sub(r" (and|or(?! later)|with) ", "\0\\1\0", g["id"])))
    if name == "gnu_free":
        family = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(g["id2"], "GPL")
        later = g.get("id6", "")
        version = g["id"] or g.get("id3") or g.get("id4") or (re.search(r"[0-9][0-9.]*", later) or [""])[0]
        version = version.rstrip(".")
        version += ".0" * (bool(version) and "." not in version)
        return "-".join(x for x in (family, version, ("or-later" if "later" in later else "only") * bool(version)) if x)
    return {"mpl_name": "MPL-"}.get(name, "") + g.get("id", "").rstrip(".")


def _read(text: str, cuts: list[tuple], joined: bool) -> list[tuple[int, int, tuple[str, str]]]:
    """(first, last, (identifier, detail)) of the known sentences of what lies between the cuts, with its lines joined or not."""
    out = []
    for a, b in zip([0, *(x[1] for x in cuts)], [*(x[0] for x in cuts), len(text)], strict=True):
        part = _WRAP.sub(lambda m: " " * len(m[0]), text[a:b]) if joined else text[a:b]
        out += [(a + first, a + last, x) for first, last, s in sentences(part) if (x := _identify(s))]
    return out


def _most(found: list[tuple[int, int, tuple[str, str]]]) -> list[tuple[str, str]]:
    """As many of the sentences as don't overlap, the longer ones of equally many, in order."""
    found = sorted(found, key=lambda x: x[1])
    ends = [x[1] for x in found]
    best: list[tuple[int, int]] = [(0, 0)]
    for first, last, _ in found:
        n, size = best[bisect_right(ends, first, 0, len(best) - 1)]
        best.append(max(best[-1], (n + 1, size + last - first)))
    out, i = [], len(found)
    while i:
        if best[i] != best[i - 1]:
            out.append(found[i - 1][2])
            i = bisect_right(ends, found[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def recognise(text: str) -> list[tuple[str, str]]:
    """The (identifier, detail) of known sentences in order.

    Sentences are looked for line by line, and in each paragraph (lines up to an empty one) with its lines joined,
    where licence texts are wrapped, also with the lines that are known sentences kept apart; of overlapping finds those count
    that make the most sentences. An SPDX tag with its licence expression is a sentence wherever it stands.
    """
    out: list[tuple[str, str]] = []
    for paragraph in re.split(r"\n[^\w\n]*\n", text):
        if not _CRITICAL.search(paragraph.lower()):
            continue
        tags = [(*m.span(), ("spdx", spdx_ids(m[1]))) for m in _TAG.finditer(paragraph)]
        found = by_line = sorted(tags + _read(paragraph, tags, False))
        if "\n" in paragraph:
            found = by_line + _read(paragraph, tags, True)
            if len(by_line) > len(tags):
                found += _read(paragraph, by_line, True)
        out += _most(found)
    return out


def match_rules(found: list[tuple[str, str]]) -> list[str]:
    """The licences of a sequence of identified sentences, each once, in the order of their first sentence.

    Copyright lines between the sentences of a rule are passed over.
    """
    items = [(n, x) for n, x in enumerate(found) if x[0] != "copyright"]
    got: list[tuple[int, int, str]] = []
    for licence, sequence in RULES:
        i = 0
        while i + len(sequence) <= len(items):
            part = items[i : i + len(sequence)]
            if all(want in (x[0], f"{x[0]}={x[1]}") for (_, x), want in zip(part, sequence, strict=True)):
                got += [(part[0][0], n, name) for n, name in enumerate(licence.format(part[0][1][1]).split(","))]
                del items[i : i + len(sequence)]
            else:
                i += 1
    return list(dict.fromkeys(name for *_, name in sorted(got)))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentences): for each row, the licences that its whole text names or holds, and the known sentences' identifiers.

    Both are arrays in the order of the text, empty for null and empty texts and where nothing is known; a text can
    have sentences and no licence. Repeated and null ids give a row each; other columns are not read, whatever their names; the table may
    be empty; a text may be as long as a row can be and is read to its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches):
            column = batch.column(1)
            maybe = pc.fill_null(pc.match_substring_regex(column, CRITICAL, ignore_case=True), False).to_pylist()
            found = [recognise(column[i].as_py()) if maybe[i] else [] for i in range(batch.num_rows)]
            kind = pa.list_(pa.string())
            yield pa.record_batch([batch.column(0), pa.array([match_rules(x) for x in found], kind), pa.array([[n for n, _ in x] for x in found], kind)], ["doc_id", "licenses", "sentences"])

    return texts(documents).mapInArrow(run, "doc_id long, licenses array<string>, sentences array<string>")
