"""Text functions as Column expressions; everything stays in the JVM.

Word boundaries are ASCII ones, written as look-around, so results don't depend on the Java version.
Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COMMANDS, EXCERPT_CHARS, METADATA_CHARS, STOP_WORDS, TRUTH_MIN_CHARS, VERDICTS

# What separates names.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_'])", "(?![A-Za-z0-9_'])"
#: What trimming takes away: all white space at both ends.
_TRIM = r"(?U)^\s+|\s+$"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def strip_from_token(text: Column, token: str) -> Column:
    """The text before the first whole ``token``; all of it if there is none."""
    return F.regexp_replace(text, rf"(?s){_BEFORE}{token}{_AFTER}.*$", "")


def strip_proof(source: Column) -> Column:
    return strip_from_token(source, "proof")


def strip_command(source: Column, commands: tuple[str, ...] = COMMANDS) -> Column:
    """Without a leading command, of which a space is left."""
    return F.regexp_replace(source, rf"^\s*(?:{'|'.join(commands)})(?![A-Za-z0-9_])", " ")


def strip_name(source: Column) -> Column:
    """Without a leading ``name [attributes]:``, of which a space is left."""
    # fixed value: how a source block writes a name and its attributes
    return F.regexp_replace(source, r"^\s*[A-Za-z_][A-Za-z0-9_'.]*\s*(?:\[[^\]]*\])?\s*:(?!:)", " ")


def normalise_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def statement(source: Column) -> Column:
    """What a source block states: without command, name, attributes and proof, white space normalised."""
    return trim(normalise_space(strip_name(strip_command(strip_proof(source)))))


def metadata_words(text: Column) -> Column:
    """Lower-cased words of more than three letters that aren't stop words, joined by a space."""
    lowered = F.regexp_replace(F.lower(text), r"(?<![A-Za-z0-9_])[a-z]{1,3}(?![A-Za-z0-9_])|[^a-z ]", " ")
    return F.array_join(F.filter(F.split(lowered, " +"), lambda w: ~w.isin("", *STOP_WORDS)), " ")


def mentions(text: Column, token: str, symbols: Mapping[str, str] | None = None) -> Column:
    """Whether a text mentions a token: a name as a whole component, anything else as a part. ``symbols`` decode written symbols."""
    token = (symbols or {}).get(token, token)
    if all(c.isalnum() or c in "_'." for c in token):
        # fixed values: what may stand in a name, and what may not stand beside it
        quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in token)
        return text.rlike(rf"(?<![\p{{L}}\p{{N}}_']){quoted}(?![\p{{L}}\p{{N}}_'])")
    return F.contains(text, F.lit(token))


def marked(text: Column) -> Column:
    """What stands between the first ``<BEGIN>`` (or the start) and the next ``<END>`` (or the end), trimmed."""
    at = F.instr(text, "<BEGIN>")
    rest = F.when(at > 0, F.substr(text, at + len("<BEGIN>"))).otherwise(text)
    return trim(F.substring_index(rest, "<END>", 1))


def template(pattern: str, **values: Column) -> Column:
    """``{key}`` replaced by columns; ``{{`` and ``}}`` are braces. Values are not expanded again; unknown keys and stray braces raise ``ValueError``."""
    parts: list[Column] = []
    text, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 2] in ("{{", "}}"):
            text += c
            i += 2
        elif c == "{":
            end = pattern.find("}", i)
            key = pattern[i + 1 : end]
            if end < 0 or key not in values:
                raise ValueError(f"bad placeholder in template: {pattern[i : i + 30]!r}")
            if text:
                parts.append(F.lit(text))
            parts.append(values[key])
            text, i = "", end + 1
        elif c == "}":
            raise ValueError("unmatched } in template")
        else:
            text += c
            i += 1
    return F.concat(*parts, F.lit(text))


def truncate(text: Column, n: int | Column) -> Column:
    return F.left(text, F.lit(n) if isinstance(n, int) else n)


def entry_of(identifier: Column, folder: str = "/thys/") -> Column:
    """The path segment after ``folder``, or an empty string."""
    return F.regexp_extract(identifier, rf"{folder}([^/]*)", 1)


def base_name(name: Column) -> Column:
    """The last dotted component."""
    return F.substring_index(name, ".", -1)


def qualifier(theory: Column, declared: Column, facts: Column) -> Column:
    """The part of the first declared name between the theory and its base name; null if there is none. Facts count only if nothing is declared."""
    first = F.get(F.when(F.size(declared) > 0, declared).otherwise(facts), F.lit(0))
    prefix = F.concat(base_name(theory), F.lit("."))
    rest = F.when(F.startswith(first, prefix), F.substr(first, F.length(prefix) + 1))
    return F.nullif(F.regexp_extract(rest, r"^(.*)\.[^.]*$", 1), F.lit(""))


def names(*lists: Column, most: int | None = 20) -> tuple[Column, Column]:
    """(distinct names, how many more): with ``most``, without trailing ``(n)`` and the first so many."""
    every = F.array_distinct(F.concat(*lists))
    if most is None:
        return every, F.lit(0)
    short = F.array_distinct(F.transform(every, lambda x: F.regexp_replace(x, r"\([0-9]+\)$", "")))
    return F.slice(short, 1, most), F.greatest(F.size(short) - most, F.lit(0))


def truth_names(*lists: Column) -> Column:
    """Distinct non-empty base names."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), base_name), lambda x: x != ""))


def verdict(raw: Column) -> tuple[Column, Column]:
    """(verdict, justification) of a judgement, UNKNOWN with the text itself where none is found."""
    text = marked(raw)
    word = F.upper(F.regexp_extract(text, r"VERDICT\s*:\s*([A-Za-z]+)", 1))
    known = word.isin(*VERDICTS)
    rest = trim(F.regexp_replace(text, r"(?s)^.*?VERDICT\s*:\s*[A-Za-z]+", ""))
    return F.when(known, word).otherwise("UNKNOWN"), truncate(F.when(known, rest).otherwise(text), 300)


def excerpt(source: Column, n: int = EXCERPT_CHARS) -> Column:
    return trim(truncate(strip_proof(source), n))


def describe_prompt(pattern: str, source: Column, title: Column, abstract: Column, limit: int = METADATA_CHARS, n: int = EXCERPT_CHARS) -> Column:
    """The describing prompt: an excerpt, and title and abstract within a joint limit."""
    title, abstract = metadata_words(F.coalesce(title, F.lit(""))), metadata_words(F.coalesce(abstract, F.lit("")))
    room = F.greatest(F.lit(0), F.lit(limit - 3) - F.length(title))
    short = F.when(F.length(title) + F.length(abstract) > limit, F.concat(truncate(abstract, room), F.lit("..."))).otherwise(abstract)
    return template(pattern, theorem_content=excerpt(source, n), title=F.when(title == "", "-- no title --").otherwise(title), abstract=F.when(short == "", "-- no abstract --").otherwise(short))


def embedding_input(pattern: str, description: Column, source: Column) -> Column:
    return template(pattern, doc_src=F.concat(description, F.lit("\n\n"), trim(source)))


def combine_query(mode: str, original: Column, expanded: Column) -> Column:
    """The text that is embedded: ``original``, ``expanded``, or ``combined``."""
    both = {"original": original, "expanded": expanded, "combined": F.concat(original, F.lit("\n\n"), expanded)}
    if mode not in both:
        raise ValueError(f"unknown query mode: {mode}")
    return both[mode]


def identity(identifier: Column, file: Column, entity: Column) -> Column:
    return F.when(F.coalesce(entity, F.lit("")) == "", identifier).otherwise(F.concat(file, F.lit("|"), entity))


def links(entry: Column, url_path: Column, relative: Column, start_line: Column, library: str, entries: str, sources: str) -> dict[str, Column]:
    """theory_url, entry_url and remote_url: the first for entries that are empty, the others for the rest."""
    own = entry != ""
    return {
        "theory_url": F.when(own, "").otherwise(F.concat(F.lit(library.rstrip("/") + "/"), url_path)),
        "entry_url": F.when(own, F.concat(F.lit(entries.rstrip("/") + "/"), entry, F.lit(".html"))).otherwise(""),
        "remote_url": F.when(own, F.concat(F.lit(sources.rstrip("/") + "/"), relative, F.lit("#L"), start_line.cast("string"))).otherwise(""),
    }


def relative_to(file: Column, roots: list[str]) -> Column:
    """The path below the first root that it starts with; null if none."""
    return F.coalesce(*(F.when(F.startswith(file, F.lit(r.rstrip("/") + "/")), F.substr(file, F.lit(len(r.rstrip("/")) + 2))) for r in roots))


def location_label(entry: Column, identifier: Column, prefix: str = "", shown: str = "") -> Column:
    """The entry, or the identifier before ``|`` with ``prefix`` shown as ``shown``."""
    place = F.substring_index(identifier, "|", 1)
    if prefix:
        place = F.when(F.startswith(place, F.lit(prefix)), F.concat(F.lit(shown), F.substr(place, F.lit(len(prefix) + 1)))).otherwise(place)
    return F.when(entry != "", entry).otherwise(place)


def url_parameters(query: Column) -> Column:
    """Parameters of a URL query as a map: ``+`` and percent codes decoded, the last of equal keys wins, a bare key is empty."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")

    def decoded(x: Column) -> Column:
        return F.url_decode(x)

    pairs = F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.instr(p, "=") > 0, decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def int_parameter(parameters: Column, key: str, default: int) -> Column:
    """A whole number; null where it is none."""
    value = F.element_at(parameters, key)
    return F.when(value.isNull(), F.lit(default)).otherwise(value.try_cast("int"))


def bool_parameter(parameters: Column, key: str, default: bool) -> Column:
    value = F.element_at(parameters, key)
    return F.when(value.isNull(), F.lit(default)).when(value == "true", True).when(value == "false", False)


def host_name(header: Column) -> Column:
    """A Host header's name: lower case, without port; brackets of an address stay."""
    return F.regexp_replace(F.lower(trim(header)), r":[0-9]*$", "")


def host_of_url(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def release_tag(tag: Column, name: str) -> tuple[Column, Column]:
    """(base, number) of a tag ``<name><base>-<number>``; null if it is not of that form."""
    ok = tag.rlike(rf"^{name}([A-Za-z0-9.]+)-([0-9]+)$")
    return F.when(ok, F.regexp_extract(tag, rf"^{name}([A-Za-z0-9.]+)-([0-9]+)$", 1)), F.when(ok, F.regexp_extract(tag, rf"^{name}([A-Za-z0-9.]+)-([0-9]+)$", 2).cast("int"))


def entry_of_changed_path(path: Column) -> Column:
    """The entry that a changed path belongs to, or the path itself."""
    a, b = F.regexp_extract(path, "^thys/([^/]+)/.*$", 1), F.regexp_extract(path, r"^metadata/entries/([^/]+)\.toml$", 1)
    return F.when(a != "", a).when(b != "", b).otherwise(path)


def same_revision(a: Column, b: Column) -> Column:
    """Short and full identifiers match by prefix, either way."""
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def long_enough(text: Column) -> Column:
    return F.length(text) >= TRUTH_MIN_CHARS
