"""Rendering of small results on the driver: Markdown, JSON and redaction."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.constants import TIERS

# Fixed value: what stays as it is in the target of a link, beside letters and digits.
_URL_SAFE = ":/?#[]@!$&*+,;=%_-~."
_SECRET_PARTS, _SECRET = ("api_key", "password"), ("authorization", "token")


def public_values(value):
    """Without secrets, at any depth."""
    if isinstance(value, dict):
        return {k: public_values(v) for k, v in value.items() if not any(p in str(k).lower() for p in _SECRET_PARTS) and str(k).lower() not in _SECRET}
    return [public_values(v) for v in value] if isinstance(value, list) else value


def secret(name: Column) -> Column:
    """Whether a setting of this name is a secret."""
    low, out = F.lower(name), F.lower(name).isin(*_SECRET)
    for part in _SECRET_PARTS:
        out = out | F.contains(low, F.lit(part))
    return out


def redacted(value: Column, kind: DataType) -> Column:
    """:func:`public_values` of a column of maps, arrays and structs: the entries and fields of secret names are gone at every depth of its type."""
    if isinstance(kind, MapType):
        kept = F.map_filter(value, lambda k, _: ~secret(k))
        return kept if isinstance(kind.valueType, StringType) else F.transform_values(kept, lambda _, v: redacted(v, kind.valueType))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redacted(v, kind.elementType))
    if isinstance(kind, StructType):
        plain = [f for f in kind.fields if not any(p in f.name.lower() for p in _SECRET_PARTS) and f.name.lower() not in _SECRET]
        return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType).alias(f.name) for f in plain)))
    return value


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def escape(text: str) -> str:
    """Text that Markdown shows as it is, in one line: white space collapsed, ``&<>`` as entities, signs with a backslash."""
    text = " ".join(text.split()).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"([\\`*_{}\[\]()#+!|~.-])", r"\\\1", text)


def link(label: str, url: str) -> str:
    """A link whose target stands between angle brackets, unsafe bytes percent-encoded; without a target, or with ``#`` for one, the label alone."""
    return f"[{escape(label)}](<{quote(url, safe=_URL_SAFE)}>)" if url not in ("", "#") else escape(label)


def fence(text: str, language: str = "") -> str:
    """A code block whose fence is longer than any run of backticks in it."""
    longest = max((len(m) for m in re.findall("`+", text)), default=0)
    mark = "`" * max(3, longest + 1)
    return f"{mark}{language}\n{text}\n{mark}"


def table(df: DataFrame, digits: int = 4) -> str:
    """A Markdown table of a small DataFrame."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else escape(str(x))
    rows = [df.columns, ["---"] * len(df.columns), *([show(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def comparison(means: DataFrame, regressions: DataFrame, improvements: DataFrame, only_before: DataFrame, only_after: DataFrame, skipped: tuple[DataFrame, DataFrame]) -> str:
    """The comparison of two runs, sections in a fixed order."""
    keys = lambda df: [f"- {r.target} / {r.query_type}" for r in df.collect()]
    moves = lambda df: [f"- {r.target} / {r.query_type}: {r.delta:+.4f}" for r in df.collect()]
    out = ["# Comparison", "", "| Queries | N | Metric | Previous | Current | Change |", "| --- | --- | --- | --- | --- | --- |"]
    rows = sorted(means.collect(), key=lambda r: (r.query_type != "All queries", r.query_type, r.metric))
    out += [f"| {r.query_type} | {r.n} | {r.metric} | {r.previous:.4f} | {r.current:.4f} | {r.delta:+.4f} |" for r in rows]
    for title, lines in (("Regressions", moves(regressions)), ("Improvements", moves(improvements)), ("Only in the previous run", keys(only_before)), ("Only in the current run", keys(only_after))):
        out += ["", f"{title}: {len(lines)}.", *lines]
    for title, df in zip(("Previous", "Current"), skipped, strict=True):
        out += ["", f"{title} skipped targets:", *(f"- {r.reason}: {r.n}" for r in df.collect())]
    return "\n".join(out) + "\n"


def duplicate_view(evidence: dict, title: str, tiers: tuple[str, ...]) -> str:
    """A Markdown view of the evidence: only candidates of ``tiers``, items without any left out, best tiers found anew among those that remain."""
    out = [f"# {escape(title)}", ""]
    order = {t: i for i, t in enumerate(tiers)}
    for kind, section in sorted(evidence["sections"].items()):
        items = []
        for item in section["items"]:
            shown = [c for c in item["candidates"] if c["tier"] in order]
            if shown:
                items.append((item, shown, min((c["tier"] for c in shown), key=order.__getitem__)))
        counts = [f"{t}: {sum(best == t for *_, best in items)}" for t in tiers]
        out += [f"## {escape(kind)}", "", f"{len(items)} items, {sum(len(s) for _, s, _ in items)} pairs; {', '.join(counts)}.", ""]
        for item, shown, best in items:
            out += [f"### {escape(str(item['id']))} ({escape(best)})", "", fence(item.get("src") or ""), ""]
            for c in shown:
                said = f"; {escape(c['verdict'])}: {escape(c.get('justification') or '')}" if c.get("verdict") else ""
                out += [f"{c['rank']}. {link(str(c['id']), c.get('url') or '')}: {escape(c['tier'])}, distance {c['distance']:.4f}{said}", "", fence(c.get("src") or ""), ""]
    return "\n".join(out)


def duplicate_evidence(sections: dict[str, tuple[DataFrame, dict]], thresholds: dict, everything: bool = False, missing: tuple[str, ...] = ()) -> dict:
    """All evidence of a duplicate analysis as one JSON value, from which the views are made.

    A section is ``(candidates(query_id, query_src, rank, id, src, distance, tier, ...), statistics)``; candidates without a tier, and items that
    are left without any, stand in it only with ``everything``. Reports are small: what the analysis keeps comes to the driver.
    """
    out: dict = {"thresholds": thresholds, "all_candidates": everything, "missing_entries": list(missing), "sections": {}}
    for kind, (candidates, statistics) in sections.items():
        rows = [r.asDict(True) for r in (candidates if everything else candidates.where("tier IS NOT NULL")).orderBy("query_id", "rank").collect()]
        items: dict = {}
        for r in rows:
            item = items.setdefault(r["query_id"], {"id": r.pop("query_id"), "src": r.pop("query_src", None), "candidates": []})
            r.pop("query_id", None), r.pop("query_src", None)
            item["candidates"].append(r)
        out["sections"][kind] = {"items": list(items.values()), **statistics}
    return out


def write_duplicates(folder: str, evidence: dict, title: str) -> None:
    """duplicates.json, and two views made from it alone: near-exact ones, and all tiers."""
    os.makedirs(folder, exist_ok=True)
    write_json(os.path.join(folder, "duplicates.json"), evidence)
    for name, tiers in (("near-exact", TIERS[:1]), ("possible", TIERS)):
        with open(os.path.join(folder, f"{name}.md"), "w", encoding="utf-8") as f:
            f.write(duplicate_view(evidence, f"{title}: {name}", tiers))


def write_json(path: str, value, redact: bool = False) -> None:
    """By a temporary file and a rename, so readers see all or nothing; a configuration is written without its secrets (``redact``)."""
    temp = f"{path}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(json.dumps(public_values(value) if redact else value, sort_keys=True, indent=1, ensure_ascii=False))
    os.replace(temp, path)


def write_benchmark(folder: str, results: list[dict], manifest: dict, summary: list[dict] = (), skipped: dict[str, str] | None = None) -> None:
    """results.json and manifest.json of a run.

    ``results`` are rows of (target, query_type, metric, value), with query, source, refined_query and top_results (rank, distance and id of the
    first hits) where known; ``summary`` has rows of (query_type, metric, average, sample_size); ``skipped`` maps targets to reasons.
    """
    os.makedirs(folder, exist_ok=True)
    nested: dict = {t: {"metadata": {"target_identifier": t, "skipped": True, "skipped_reason": why}, "queries": {}} for t, why in (skipped or {}).items()}
    for r in results:
        entry = nested.setdefault(r["target"], {"metadata": {"target_identifier": r["target"], "skipped": False}, "queries": {}})
        query = entry["queries"].setdefault(r["query_type"], {"metrics": {}})
        query["metrics"][r["metric"]] = r["value"]
        query |= {k: r[k] for k in ("query", "source", "refined_query", "top_results") if k in r}
    for r in summary:
        nested.setdefault("summary", {}).setdefault(r["query_type"], {})[r["metric"]] = {"average": r["average"], "sample_size": r["sample_size"]}
    write_json(os.path.join(folder, "results.json"), nested)
    write_json(os.path.join(folder, "manifest.json"), manifest, redact=True)
