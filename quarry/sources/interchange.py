"""Interchange folders and published generations.

An interchange folder has ``manifest.json`` and, for each kind, ``documents.jsonl`` and ``vectors.f32`` (little-endian floats, row by
row), or parts of both with a part table: record n goes with vector n. An index is a folder of immutable generations, Parquet partitioned by kind with an
inventory of chunk digests, and the file ``current.json`` that names the one in force. Publishing moves that pointer last, by a rename. The driver handles names, sizes and
counts through Hadoop's file systems; bytes are read, hashed, written and copied by tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import adler32
from ..operators import validate as check
from ..operators.report import canonical, write_json  # noqa: F401  write_json for callers of this module
from . import ranges
from .shared import Files, uri

FORMAT, VERSION, WRITER = "interchange", 1, "quarry-1"
RECORD = "id string, kind string, src string, checksum long, llm_description string, embedding_input string, entity_kname string, chapter string, session string, theory string, file string, url_path string, command string, start_line int, consts array<string>, typs array<string>, thms array<string>, entry string, entry_date string"
#: A source block.
BLOCK = "id string, src string, entity_kname string, chapter string, session string, theory string, file string, url_path string, command string, start_line int, consts array<string>, typs array<string>, thms array<string>"
#: Bytes of a vector file that one task reads.
VECTOR_BYTES = 32 << 20
#: The part table of a corpus.
PART = "name string, first long, count long, at long, record_bytes long, vector_bytes long, record_at long, vector_at long, record_sha256 string, vector_sha256 string"


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            h.update(data)
    return h.hexdigest()


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"no JSON object: {path}")
    return value


def read_prompts(folder: str) -> dict[str, str]:
    """Every ``*.txt`` by its name."""
    return {n[:-4]: open(os.path.join(folder, n), encoding="utf-8").read() for n in sorted(os.listdir(folder)) if n.endswith(".txt")}


def prompt_of(prompts: dict[str, str], key: str, kind: str) -> str:
    """A kind's own prompt, else the common one."""
    return prompts.get(f"{key}_{kind}", prompts.get(key, ""))


def prompts_for(prompts: DataFrame, key: str, kinds: DataFrame) -> DataFrame:
    """(kind, prompt) of ``kinds(kind)`` by ``prompts(name, text)``: a kind's own prompt, else the common one, else an empty one."""
    own = prompts.select(F.col("name").alias("own"), F.col("text").alias("mine"))
    common = prompts.where(F.col("name") == key).agg(F.max("text").alias("common"))
    found = kinds.select("kind").join(own, F.col("own") == F.concat(F.lit(f"{key}_"), F.col("kind")), "left").join(F.broadcast(common))
    return found.select("kind", F.coalesce("mine", "common", F.lit("")).alias("prompt"))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, title, abstract, date) of the TOML files of a folder, parsed by tasks; missing keys are empty."""
    import tomllib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tomllib.loads(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"entry": batch.column(0), **{k: pa.array([str(t.get(k, "")) for t in found], pa.string()) for k in ("title", "abstract", "date")}})

    return ranges.read_files(spark, folder, ".toml").mapInArrow(run, "entry string, title string, abstract string, date string")


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted, multi-line CSV with a header; a row with another number of fields raises when it is read."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path)


def load_results(path: str) -> dict:
    """A result file, or the one in a folder."""
    return read_json(os.path.join(path, "results.json") if os.path.isdir(path) else path)


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """(ord, vector) of a file of floats; tasks read ranges of it, so its size is no limit."""
    where, row = uri(path), dimension * 4
    size = Files(spark, os.path.dirname(where)).size(os.path.basename(where))
    if size % row:
        raise ValueError("trailing bytes in the vector file")
    rows, step = size // row, max(1, VECTOR_BYTES // row)
    plan = [ranges.Range("", 0, 0, at, min(step, rows - at), where, at) for at in range(0, rows, step)]
    return ranges.read_ranges(spark, plan, dimension, ("ord", "vector"))


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """(ord, record, and its fields) of a file of JSON lines, in its order; the line itself is kept for a lossless export."""
    where = uri(path)
    size = Files(spark, os.path.dirname(where)).size(os.path.basename(where))
    plan = [ranges.Range(where, start, end, first, n, "", 0) for start, end, first, n in ranges.line_ranges(spark, where, size)]
    return _with_fields(ranges.read_ranges(spark, plan, 0, ("ord", "record")), schema)


def _with_fields(rows: DataFrame, schema: str = RECORD) -> DataFrame:
    return rows.withColumn("fields", F.from_json("record", schema)).select(*rows.columns, "fields.*")


def plan_corpus(spark: SparkSession, base: str, spec: dict) -> list[ranges.Range]:
    """The ranges of a corpus below ``base``, record n with vector n: of its parts, or of the two single files, where lines are counted once by tasks.

    Raises ``ValueError`` if records and vectors aren't as many as the manifest says.
    """
    files, row, count = Files(spark, base), spec["dimension"] * 4, spec["count"]
    at = lambda name: f"{files.folder}/{name}"
    if spec.get("layout") == "parts":
        parts = spark.read.parquet(at("parts")).orderBy("at").collect()
        plan = [ranges.Range(at(f"{p['name']}.jsonl"), 0, p["record_bytes"], p["at"], p["count"], at(f"{p['name']}.f32"), 0) for p in parts]
        vectors = sum(p["vector_bytes"] for p in parts)
    else:
        vectors = files.size("vectors.f32")
        lines = ranges.line_ranges(spark, at("documents.jsonl"), files.size("documents.jsonl"))
        plan = [ranges.Range(at("documents.jsonl"), start, end, first, n, at("vectors.f32"), first) for start, end, first, n in lines]
    if vectors % row:
        raise ValueError("trailing bytes in the vector file")
    for what, n in (("records", sum(r.count for r in plan)), ("vectors", vectors // row)):
        if n != count:
            raise ValueError(f"{n} {what} instead of {count}")
    return plan


def read_corpus(spark: SparkSession, base: str, spec: dict, schema: str = RECORD) -> DataFrame:
    """(ord, record, vector, and the record's fields) of one kind of an interchange folder."""
    return _with_fields(ranges.read_ranges(spark, plan_corpus(spark, base, spec), spec["dimension"]), schema)


def block_fields(blocks: DataFrame) -> DataFrame:
    """The thirteen fields of a source block, in order; a missing one is null."""
    return blocks.select(*((F.col(c) if c in blocks.columns else F.lit(None).cast(t)).alias(c) for c, t in (x.split(" ") for x in BLOCK.split(", "))))


def _files(folder: str) -> Files:
    return Files(SparkSession.active(), folder)


def current(index: str) -> str:
    """The folder of the generation in force."""
    return f"{index.rstrip('/')}/{json.loads(_files(index).read('current.json'))['generation']}"


def open_corpus(spark: SparkSession, generation: str, kind: str) -> DataFrame:
    """A corpus of one generation: a partition, so other kinds aren't read. ``ord`` gives the order of documents."""
    return spark.read.parquet(f"{generation}/data").where(F.col("corpus") == kind)


def point(corpus: DataFrame, identifier: str) -> DataFrame:
    return corpus.where(F.col("id") == identifier).limit(1)


def publish(index: str, staging: str) -> str:
    """Move a finished generation ``staging`` of the index into place and then the pointer, both by renames."""
    name, files = f"generation-{uuid.uuid4().hex}", _files(index)
    if not files.move(os.path.basename(staging.rstrip("/")), name):
        raise OSError(f"{staging} can't be moved into place")
    files.swap("current.json", json.dumps({"generation": name}, indent=1))
    return f"{index.rstrip('/')}/{name}"


def lease(generation: str) -> str:
    """Mark a generation as in use; the mark's name, for :func:`release` after use. :func:`prune` leaves marked ones."""
    mark = f"lease-{uuid.uuid4().hex}"
    if not _files(generation).exists() or not _files(generation).create(mark, ""):
        raise FileNotFoundError(generation)
    return mark


def release(generation: str, mark: str) -> None:
    _files(generation).remove(mark)


def prune(index: str, seconds: float = 86400.0) -> list[str]:
    """Delete all generations but the one in force and those with a lease younger than ``seconds``."""
    files = _files(index)
    keep = os.path.basename(current(index))
    held = lambda name: any(x.startswith("lease-") and time.time() - files.modified(f"{name}/{x}") < seconds for x in files.names(name))
    gone = [n for n in files.names() if n.startswith("generation-") and n != keep and not held(n)]
    for n in gone:
        files.remove(n)
    return gone


def _check_files(spark: SparkSession, base: str, kind: str, spec: dict) -> None:
    """Every file of a corpus as its manifest says: parts by tasks each, single files by a task a file."""
    if spec.get("layout") == "parts":
        parts = spark.read.parquet(f"{base}/parts")
        if _parts_root(parts) != spec["root"]:
            raise ValueError(f"{kind}: the part table is not what the manifest says")
        zero = F.lit(0).cast("long")
        want = parts.select(F.explode(F.array(*(F.struct(F.concat("name", F.lit(f".{end}")).alias("file"), F.col(f"{x}_bytes").alias("length"), F.col(f"{x}_sha256").alias("sha256")) for x, end in (("record", "jsonl"), ("vector", "f32"))))).alias("p")).select("p.*", zero.alias("chunk"), zero.alias("start"))
        if bad := ranges.faults(want, ranges.digests(base, want)).limit(5).collect():
            raise ValueError(f"{kind}: {', '.join(f'{r.file} is {r.fault}' for r in bad)}")
        return
    for name in spec["files"]:
        if not check.safe_path(name):
            raise ValueError(f"{kind}: unsafe path {name}")
    found = ranges.whole_digests(spark, base, list(spec["files"]))
    for name, digest in spec["files"].items():
        if found[name] != digest:
            raise ValueError(f"{kind}/{name} is not what the manifest says")


def _parts_root(parts: DataFrame) -> str:
    line = F.concat_ws(" ", "name", "count", "record_sha256", "vector_sha256")
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x.line), "\n"), 256)).first()[0]


def import_interchange(spark: SparkSession, folder: str, index: str, files_per_corpus: int | None = None, formats: tuple[str, ...] = (FORMAT,)) -> str:
    """Check an interchange folder, write it as a generation and publish that. A fault leaves the index as it was.

    ``formats`` are the names of the format that are accepted: other writers of the same layout call it otherwise. Tasks digest the files and read
    records with their vectors by ranges; the checks run on the table that they write.
    """
    manifest = json.loads(_files(folder).read("manifest.json"))
    check.check_manifest(manifest, formats, VERSION)
    files = _files(index)
    files.make()
    staging = f"staging-{uuid.uuid4().hex}"
    at = f"{files.folder}/{staging}"
    try:
        for spec in manifest["corpora"]:
            kind = spec["kind"]
            if not check.safe_name(kind):
                raise ValueError(f"unsafe name: {kind}")
            base = f"{_files(folder).folder}/{kind}"
            _check_files(spark, base, kind, spec)
            data = read_corpus(spark, base, spec).withColumn("corpus", F.lit(kind))
            if files_per_corpus:
                data = data.repartition(files_per_corpus)
            data.write.mode("append").partitionBy("corpus").parquet(f"{at}/data")
            records = open_corpus(spark, at, kind)
            counts = check.record_faults(records, kind).first().asDict()
            if counts["n"] != spec["count"] or any(v for k, v in counts.items() if k != "n"):
                raise ValueError(f"{kind}: {counts}")
            if not check.checksum_faults(records).isEmpty():
                raise ValueError(f"{kind}: a source doesn't have its checksum")
            if not check.vector_faults(records, spec["dimension"], spec["metric"]).isEmpty():
                raise ValueError(f"{kind}: invalid vectors")
        manifest["corpora"] = [{k: v for k, v in c.items() if k not in ("files", "layout", "root")} for c in manifest["corpora"]]
        listed = [(n, size) for n, size in files.walk(f"{staging}/data") if n.endswith(".parquet")]
        inventory = ranges.digests(at, ranges.chunks(spark, [(n.removeprefix(f"{staging}/"), size) for n, size in listed]))
        inventory.write.parquet(f"{at}/inventory")
        shipped = {"writer": WRITER, "root": ranges.root_of(spark.read.parquet(f"{at}/inventory"))}
        files.replace(f"{staging}/manifest.json", json.dumps(manifest | {"generation": shipped}, sort_keys=True, indent=1, ensure_ascii=False))
        return publish(index, staging)
    except BaseException:
        files.remove(staging)
        raise


def install_generation(spark: SparkSession, folder: str, index: str) -> str:
    """Install a shipped generation: known writer, every chunk of every file as its inventory says, and the inventory as its manifest."""
    manifest = json.loads(_files(folder).read("manifest.json"))
    shipped = manifest.get("generation") or {}
    if shipped.get("writer") != WRITER:
        raise ValueError("written by another version")
    source = _files(folder)
    inventory = spark.read.parquet(f"{source.folder}/inventory")
    if not inventory.where(~check.is_safe_path(F.col("file"))).isEmpty() or ranges.root_of(inventory) != shipped["root"]:
        raise ValueError("the inventory is not what the manifest says")
    listed = [(n, size) for n, size in source.walk("data") if n.endswith(".parquet")]
    found = ranges.digests(source.folder, ranges.chunks(spark, listed))
    if bad := ranges.faults(inventory, found).orderBy("file", "chunk").limit(5).collect():
        raise ValueError(f"{', '.join(f'{r.file}, chunk {r.chunk}, is {r.fault}' for r in bad)}")
    files = _files(index)
    files.make()
    staging = f"staging-{uuid.uuid4().hex}"
    try:
        _ship(spark, source, f"{files.folder}/{staging}")
        return publish(index, staging)
    except BaseException:
        files.remove(staging)
        raise


def _ship(spark: SparkSession, source: Files, target: str) -> None:
    """Data and inventory by tasks, then the manifest; leases stay behind."""
    listed = [x for part in ("data", "inventory") for x in source.walk(part)]
    ranges.copied(spark, source.folder, target, listed)
    _files(target).replace("manifest.json", source.read("manifest.json"))


def import_index(spark: SparkSession, folder: str, index: str, formats: tuple[str, ...] = (FORMAT,)) -> str:
    """A shipped generation or an interchange folder, by the manifest."""
    return install_generation(spark, folder, index) if "generation" in json.loads(_files(folder).read("manifest.json")) else import_interchange(spark, folder, index, formats=formats)


def export_generation(spark: SparkSession, generation: str, target: str) -> None:
    if _files(target).exists():
        raise FileExistsError(target)
    _ship(spark, _files(generation), _files(target).folder)


def _write_ordered(rows: DataFrame, base: str, layout: str) -> dict:
    """Write ``rows(ord, record, vector)`` in order; what the manifest says of them. Tasks write, hash and place a range each."""
    if layout not in ("single", "parts"):
        raise ValueError(f"unknown layout: {layout}")
    spark = rows.sparkSession
    _files(base).make()
    parts = ranges.write_parts(rows, base)
    count = sum(p["count"] for p in parts)
    if layout == "single":
        ranges.put_together(spark, base, parts, {"jsonl": "documents.jsonl", "f32": "vectors.f32"})
        return {"count": count, "files": ranges.whole_digests(spark, base, ["documents.jsonl", "vectors.f32"])}
    spark.createDataFrame(parts, PART).write.parquet(f"{_files(base).folder}/parts")
    return {"count": count, "layout": "parts", "root": _parts_root(spark.read.parquet(f"{_files(base).folder}/parts"))}


def export_interchange(spark: SparkSession, generation: str, target: str, layout: str = "single") -> None:
    """Records and vectors in document order with fresh digests: ``single`` files, as other readers expect them, or ``parts`` with a table."""
    if _files(target).exists():
        raise FileExistsError(target)
    manifest = json.loads(_files(generation).read("manifest.json"))
    manifest.pop("generation", None)
    for spec in manifest["corpora"]:
        wrote = _write_ordered(open_corpus(spark, generation, spec["kind"]), f"{_files(target).folder}/{spec['kind']}", layout)
        if wrote["count"] != spec["count"]:
            raise ValueError(f"{spec['kind']} has {wrote['count']} documents instead of {spec['count']}")
        spec |= wrote
    _files(target).replace("manifest.json", json.dumps(manifest, sort_keys=True, indent=1, ensure_ascii=False))


def write_interchange(documents: dict[str, DataFrame], specs: dict[str, dict], target: str, provenance: dict | None = None, form: str = FORMAT, layout: str = "single") -> None:
    """Write described documents ``(ord, id, src, ..., vector)`` of each kind as an interchange folder."""
    corpora = []
    for kind, df in documents.items():
        fields = [c for c in df.columns if c not in ("ord", "vector", "checksum")]
        rows = df.withColumn("checksum", adler32("src")).select("ord", F.to_json(F.struct(*fields, "checksum")).alias("record"), "vector")
        corpora.append(specs[kind] | {"kind": kind} | _write_ordered(rows, f"{_files(target).folder}/{kind}", layout))
    manifest = {"format": form, "version": VERSION, "corpora": corpora} | ({"provenance": provenance} if provenance else {})
    _files(target).replace("manifest.json", json.dumps(manifest, sort_keys=True, indent=1, ensure_ascii=False))


def spec_key(spec: dict) -> str:
    return canonical(spec)
