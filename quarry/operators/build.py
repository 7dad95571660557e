"""Corpus building: metadata, descriptions and embeddings through injected functions and keyed stores."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import adler32
from ..functions.constants import DISTANCE, VERDICTS
from ..sources.shared import written
from .duplicates import judged
from .report import canonical
from .store import Store

#: Code points of an embedder's input; texts in a call.
EMBED_CHARS, EMBED_BATCH = 8000, 32
#: Query modes of the benchmark's strategies: whether the index has metadata, and what is embedded.
STRATEGIES = {"baseline": (False, "original"), "R": (False, "expanded"), "UR": (False, "combined"), "M": (True, "original"), "MR": (True, "expanded"), "MUR": (True, "combined")}


@dataclass(frozen=True)
class Completion:
    text: str
    truncated: bool = False


class Failure(Exception):
    """A model call that gave nothing usable."""


def select_blocks(blocks: DataFrame, commands: list[str]) -> DataFrame:
    """Source blocks of a kind: those whose command is one of the list; the predicate reaches the scan."""
    return blocks.where(F.col("command").isin(*commands))


def with_metadata(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of ``metadata(entry, title, abstract, date)``; what is missing is empty."""
    out = documents.join(metadata, "entry", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "abstract", "date")})


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON list: a store's key."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def call_key(text: Column, model: str = "", backend: str = "", extra: dict | None = None) -> Column:
    """The key of a model call: everything that its answer depends on, the extra body as canonical JSON."""
    return cache_key(F.lit(backend), F.lit(model), F.lit(canonical(extra or {})), text)


def misses(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct keys of ``wanted(key, ...)`` that the store lacks."""
    return wanted.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")


def completed(prompt: str, generate: Callable[[str, float], Completion], cut_off: Callable[[str], str] = lambda _: "unusable", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Completion:
    """A completion under a policy: a cut-off one is unusable (try again), a fallback (the last resort) or sufficient.

    Later attempts are warmer, after a pause of 2 ** n seconds, 30 at most.
    """
    fallback: Completion | None = None
    error = "no attempt"
    for n in range(attempts):
        if n:
            sleep(min(30.0, 2.0**n))
        try:
            c = generate(prompt, 0.3 if n else 0.0)
        except OSError as e:
            error = str(e)
            continue
        if c.text.strip() and (not c.truncated or (kind := cut_off(c.text)) == "sufficient"):
            return c
        if c.text.strip() and kind == "fallback":
            fallback = fallback or c
        error = "empty or cut off"
    if fallback is not None:
        return fallback
    raise Failure(error)


def describe(wanted: DataFrame, generate: Callable[[str, float], Completion], attempts: int = 3, cut_off: Callable[[str], str] = lambda _: "fallback", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, text, truncated, status, error) of ``wanted(key, prompt)``: status ok, truncated or failed. A failure costs its row only.

    ``cut_off`` tells what a cut-off completion is worth, see :func:`completed`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
                try:
                    c = completed(prompt, generate, cut_off, attempts, sleep)
                    rows.append((key, c.text, c.truncated, "truncated" if c.truncated else "ok", None))
                except Failure as e:
                    rows.append((key, None, False, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["key", "text", "truncated", "status", "error"])

    return wanted.select("key", "prompt").mapInPandas(run, "key string, text string, truncated boolean, status string, error string")


def has_verdict(text: str) -> str:
    """A cut-off judgement is sufficient if it came to a known verdict, else unusable."""
    m = re.search(r"VERDICT\s*:\s*([A-Za-z]+)", text)
    return "sufficient" if m and m[1].upper() in VERDICTS else "unusable"


def judge(pairs: DataFrame, pattern: str, generate: Callable[[str, float], Completion], attempts: int = 3, weak: float = DISTANCE, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``pairs(rank, distance, src, other_src, ...)`` with verdict, justification, judge_truncated and judge_error.

    Only near candidates among the first few are judged, others have nulls; equal prompts are judged once. A failed judgement has its error and no verdict.
    """
    asked = pairs.withColumn("_prompt", F.when(judged(F.col("rank"), F.col("distance"), weak=weak), T.template(pattern, first=T.excerpt(F.col("src")), second=T.excerpt(F.col("other_src")))))
    asked = asked.withColumn("_key", F.sha2("_prompt", 256))
    told = describe(asked.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt")).dropDuplicates(["key"]), generate, attempts, has_verdict, sleep)
    word, why = T.verdict(F.col("text"))
    ok = F.col("status") != "failed"
    told = told.select(F.col("key").alias("_key"), F.when(ok, word).alias("verdict"), F.when(ok, why).alias("justification"), F.when(ok, F.col("truncated")).alias("judge_truncated"), F.col("error").alias("judge_error"))
    return asked.join(told, "_key", "left").drop("_key", "_prompt")


def embed(wanted: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """(key, vector) of ``wanted(key, text)``: calls of ``batch`` truncated texts; a wrong number of vectors raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                vectors = model(some["text"].tolist())
                if len(vectors) != len(some):
                    raise ValueError("the embedder returned another number of vectors")
                yield pd.DataFrame({"key": some["key"].tolist(), "vector": vectors})

    cut = wanted.select("key", T.truncate(F.col("text"), EMBED_CHARS).alias("text"))
    return cut.mapInPandas(run, "key string, vector array<float>")


def through_store(wanted: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame], keep: Column | None = None, name: str | None = None) -> DataFrame:
    """``wanted(key, ...)`` with the store's columns: misses are computed once and committed, then the buckets of the keys are read back.

    ``keep`` marks the rows that are stored; others, as failures, are computed again next time. Builds may share a store: each key stays
    there once. A commit called ``name`` is done once, see :class:`store.Store`.
    """
    kept = Store(wanted.sparkSession, folder)
    kept.fill(wanted, compute, keep, name)
    return kept.joined(wanted)


def documents(blocks: DataFrame, prompt: str, embed_prompt: str, store: str, generate: Callable[[str, float], Completion], model: str = "", backend: str = "", extra: dict | None = None) -> DataFrame:
    """Described documents of ``blocks(id, src, entry, title, abstract, ...)``: llm_description, embedding_input, checksum and artifact. Undescribed ones are dropped."""
    text = T.describe_prompt(prompt, F.col("src"), F.col("title"), F.col("abstract"))
    asked = blocks.withColumn("prompt", text).withColumn("key", call_key(F.col("prompt"), model, backend, extra))
    told = through_store(asked, store, lambda m: describe(m, generate), F.col("status") != "failed")
    said = T.marked(F.col("text"))
    out = told.withColumn("llm_description", said).withColumn("checksum", adler32("src"))
    out = out.withColumn("embedding_input", T.embedding_input(embed_prompt, F.col("llm_description"), F.col("src")))
    artifact = F.struct(F.col("text").alias("llm_description"), F.col("prompt"), F.col("checksum").alias("adler32_checksum"))
    return out.withColumn("description_artifact", artifact).drop("key", "prompt", "text", "status", "error")


def with_vectors(described: DataFrame, store: str, model: Callable[[list[str]], list[list[float]]], name: str = "", backend: str = "", extra: dict | None = None) -> DataFrame:
    keyed = described.withColumn("text", F.col("embedding_input")).withColumn("key", call_key(T.truncate(F.col("text"), EMBED_CHARS), name, backend, extra))
    return through_store(keyed, store, lambda m: embed(m, model)).drop("key", "text")


def hash_embedder(dimension: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            r = random.Random(t)
            out.append([r.gauss(0, 1) for _ in range(dimension)])
        return out

    return run


def progress(statuses: DataFrame, seconds: float | None = None, total: int | None = None) -> DataFrame:
    """One row: processed, reused, generated, truncated, failed; with ``seconds`` the rate, with ``total`` also the seconds that are left (null without a rate)."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    out = statuses.agg(F.count(F.lit(1)).alias("processed"), is_("stored").alias("reused"), is_("ok", "truncated").alias("generated"), is_("truncated").alias("truncated"), is_("failed").alias("failed"))
    if seconds is not None:
        out = out.withColumn("rate", F.try_divide(F.col("processed"), F.lit(float(seconds))))
        if total is not None:
            out = out.withColumn("seconds_left", F.try_divide(F.lit(float(total)) - F.col("processed"), "rate"))
    return out


def incomplete_sessions(exports: DataFrame, name: str) -> DataFrame:
    """Sessions with a theory that lacks the export ``name``, of ``exports(session, theory, name)``."""
    has = exports.groupBy("session", "theory").agg(F.bool_or(F.col("name") == name).alias("has"))
    return has.where(~F.col("has")).select("session").distinct()


def unbuilt(sessions: DataFrame, done: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(session, reason): sessions that aren't done, with their ``error`` or as ``not built``, or lack exports: a row each, however many have one reason."""
    out = sessions.join(done.select("session").distinct().withColumn("done", F.lit(True)), "session", "left").join(incomplete.select("session").distinct().withColumn("lacks", F.lit(True)), "session", "left")
    reason = F.when(F.col("done").isNull(), F.coalesce("error", F.lit("not built"))).when(F.col("lacks"), "missing exports")
    return out.select("session", reason.alias("reason")).where("reason IS NOT NULL")


def unbuilt_counts(members: DataFrame) -> DataFrame:
    """(reason, sessions, first): of ``unbuilt``'s rows, how many sessions have a reason and the first of them by name."""
    return members.groupBy("reason").agg(F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first"))


def _ancestors(sessions: DataFrame, exclude: list[str]) -> DataFrame:
    """(session, depth, under): how many ancestors each session with a parent has, and whether one of them is excluded.

    Each row knows the farthest ancestor reached, and a round joins it with what that one knows: twice as far each time, a row a session.
    A cycle raises ``ValueError``.
    """
    under = F.col("up").isin(*exclude) if exclude else F.lit(False)
    own = sessions.where("session IS NOT NULL AND parent IS NOT NULL").select("session", F.col("parent").alias("up")).distinct()
    now = written(own.withColumn("depth", F.lit(1)).withColumn("under", under))
    left = now.count()
    while left and not now.where("up IS NOT NULL").isEmpty():
        on = now.select(F.col("session").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("under").alias("also"))
        step = now.join(on, "up", "left")
        now = written(step.select("session", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("under") | F.coalesce("also", F.lit(False))).alias("under")))
        if left == 1 and not now.where("up IS NOT NULL").isEmpty():
            raise ValueError("sessions form a cycle")
        left = max(1, left // 2)
    return now.groupBy("session").agg(F.max("depth").alias("depth"), F.max("under").alias("under"))


def select_sessions(sessions: DataFrame, names: list[str], exclude: list[str], main: str, sets: dict[str, Column] | None = None) -> DataFrame:
    """(session, parent, group, depth): sessions by name, by group, ``all``, or a set named in ``sets`` (a condition each), without the excluded ones and their descendants.

    ``main`` is the root of the hierarchy and not among them; ``depth`` counts the ancestors, so that order by it puts parents first. Unknown
    names raise. Only the names asked for come to the driver.
    """
    spark = sessions.sparkSession
    conditions = {"all": F.lit(True)} | (sets or {})
    asked = spark.createDataFrame([(n,) for n in (*names, *exclude) if n not in conditions], "name string")
    known = sessions.select(F.col("session").alias("name")).unionByName(sessions.select(F.col("group").alias("name"))).distinct()
    if unknown := [r.name for r in asked.join(known, "name", "left_anti").collect()]:
        raise ValueError(f"unknown sessions: {', '.join(sorted(set(unknown)))}")
    wanted = F.col("session").isin(*names) | F.col("group").isin(*names) if names else F.lit(False)
    for n in names:
        wanted = wanted | conditions.get(n, F.lit(False))
    gone = F.col("under") | F.col("session").isin(*exclude) if exclude else F.lit(False)
    placed = sessions.join(_ancestors(sessions, exclude), "session", "left")
    kept = placed.where(F.coalesce(wanted, F.lit(False)) & ~F.coalesce(gone, F.lit(False)) & (F.col("session") != main))
    return kept.select(*sessions.columns, F.coalesce("depth", F.lit(0)).alias("depth"))


def embeddings_of(response: dict, n: int) -> list[list[float]]:
    """The vectors of an embedding response in order of their ``index``; each of 0 to n - 1 has to be there once."""
    data = response.get("data")
    if not isinstance(data, list) or sorted(d.get("index", -1) for d in data) != list(range(n)):
        raise ValueError("the response doesn't have each index once")
    return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


class Refused(Exception):
    """A call that the service refused for good."""


def posted(transport: Callable[[str, dict, dict], tuple[int, dict]], url: str, body: dict, key: str | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer of ``transport(url, headers, body)`` -> (status, answer).

    Input and output errors and the statuses 429 and 5xx are tried again, after 2 ** n seconds, 30 at most; any other status but 2xx is refused at once. The key goes to
    this endpoint only.
    """
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    error = "no attempt"
    for n in range(attempts):
        if n:
            sleep(min(30.0, 2.0**n))
        try:
            status, answer = transport(url, headers, body)
        except OSError as e:
            error = str(e)
            continue
        if 200 <= status < 300:
            return answer
        if status != 429 and status < 500:
            raise Refused(f"status {status}")
        error = f"status {status}"
    raise OSError(error)


def embedder(transport: Callable[[str, dict, dict], tuple[int, dict]], url: str, model: str, kind: str = "openai", key: str | None = None, extra: dict | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """A model for :func:`embed` behind an HTTP service of either of two kinds: indexed answers, or a plain list under ``embeddings``."""
    if kind not in ("openai", "ollama"):
        raise ValueError(f"unknown kind of service: {kind}")

    def run(texts: list[str]) -> list[list[float]]:
        path = "/embeddings" if kind == "openai" else "/api/embed"
        answer = posted(transport, url.rstrip("/") + path, {"model": model, "input": texts} | (extra or {}), key, attempts, sleep)
        return embeddings_of(answer, len(texts)) if kind == "openai" else answer["embeddings"]

    return run


def generator(transport: Callable[[str, dict, dict], tuple[int, dict]], url: str, model: str, key: str | None = None, extra: dict | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, float], Completion]:
    """A model for :func:`describe` behind a chat service: the text, and whether its length cut it off."""

    def run(prompt: str, temperature: float) -> Completion:
        body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]} | (extra or {})
        choice = posted(transport, url.rstrip("/") + "/chat/completions", body, key, attempts, sleep)["choices"][0]
        return Completion(choice["message"].get("content") or "", choice.get("finish_reason") == "length")

    return run
