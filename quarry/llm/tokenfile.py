"""Token ids as flat binary files.

A data set is a folder: for each partition ``<name>.ids`` (unsigned little-endian ids, nothing between documents),
``<name>.ends`` (for n documents n + 1 signed 64-bit offsets into it, counted in ids, the first 0) and ``<name>.docs`` (n
signed 64-bit document ids), and a Parquet manifest, one row a partition. Documents ascend by
id within a partition and from one to the next. A partition's base, the ids before it, is the prefix
sum of the counts in the manifest; it is no part of the files, so partitions are written without knowing each other.

A task names its files anew at each attempt and the manifest lists those of the attempt that counted,
so a lost executor or a second attempt leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions, split_batches, text_offsets, texts, written
from .files import create, mapped

#: Bytes of text that are encoded at once; a piece is looked up once in them.
BATCH_BYTES = 8 << 20
#: Pieces of text whose ids a worker remembers; when there are more, it forgets all and begins anew.
REMEMBERED = 800_000
_SHORT = 100
_GRAPH = "!-~¡-ɏ"
_PLAIN = re.compile(f"(?<=[{_GRAPH}]) (?=[{_GRAPH}])|(?<=[{_GRAPH}])(?=\\n[{_GRAPH}])")
_ENDS = frozenset(".,")
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())
# by byte in UTF-8: ASCII beyond the space; the first of a two-byte Latin letter; a following one
_VISIBLE, _LEAD, _REST, _GAP = np.zeros((4, 256), bool)
_VISIBLE[0x21:0x7F] = _LEAD[0xC3:0xC9] = _REST[0x80:0xC0] = _GAP[[0x0A, 0x20]] = True


def odd_rows(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, whether a space or line break may stand otherwise than singly between two visible Latin characters."""
    n = len(offsets) - 1
    at = np.flatnonzero(_GAP[buf])
    row = np.searchsorted(offsets, at, "right") - 1
    inner = (at > offsets[row]) & (at + 1 < offsets[row + 1])
    before, after = buf[np.maximum(at - 1, 0)], buf[np.minimum(at + 1, len(buf) - 1)]
    two = _REST[before] & _LEAD[buf[np.maximum(at - 2, 0)]] & (at - 2 >= offsets[row])
    out = np.zeros(n, bool)
    out[row[~(inner & (_VISIBLE[after] | _LEAD[after]) & (_VISIBLE[before] | two))]] = True
    return out


class Encoder:
    """Ids by the ``tokenizers`` library, without special tokens, as bytes of unsigned integers.

    A single space or line break between two visible characters always begins a match of the byte-level pre-tokenizer, and so
    does a mark after a letter. So the pieces between them encode apart, and a piece seen before is looked up. New pieces
    go to the library many at a time, as one text, and its ids are dealt out by the bytes that they stand
    for. With ``encode_special_tokens`` special tokens' strings in a text are ordinary text; without it, as in the library's
    default, each is its token, and texts that hold one go to the library whole.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        from tokenizers import Tokenizer

        self.library, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.special = [] if encode_special_tokens else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0)
        self.dtype = "<u2" if top < 1 << 16 else "<u4"
        self.width = np.zeros(top + 1, np.int64)  # bytes of text that an id stands for: the vocabulary has a character for each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}  # by a piece without the space before it, or with its line break
        self.mark = {x: self._raw([x])[0].tobytes() for x in _ENDS}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str], known: dict[str, bytes]) -> dict[str, bytes]:
        """Ids of each piece. All are visible at both ends but for a first line break, so their concatenation splits into them."""
        stems = {p: p[:-1] for p in pieces if p[-1] in _ENDS and len(p) > 1 and p[-2] in _LETTERS}
        whole = list((pieces - stems.keys()) | (set(stems.values()) - known.keys()))
        out: dict[str, bytes] = {}
        step = 4096
        for at in range(0, len(whole), step):
            some = whole[at : at + step]
            spaced = [p if p[0] == "\n" else " " + p for p in some]
            ids = self._raw(["".join(spaced)])[0]
            cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in spaced]), "left") + 1
            data, size = ids.tobytes(), ids.itemsize
            first = 0
            for p, last in zip(some, (cuts * size).tolist(), strict=True):
                out[p] = data[first:last]
                first = last
        for p, stem in stems.items():
            out[p] = (out.get(stem) or known[stem]) + self.mark[p[-1]]
        return out

    def _table(self, words: list[str]) -> dict[str, bytes]:
        """Something to look all ``words`` up in."""
        missing = {w for w in words if w not in self.known}
        long = {w for w in missing if len(w) > _SHORT}
        self.known.update(self._learn(missing - long, self.known))
        return self.known | self._learn(long, self.known) if long else self.known

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column; null counts as empty."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        texts = texts.fill_null("")
        odd = odd_rows(*text_offsets(texts))
        out: list[np.ndarray | None] = [None] * len(texts)
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        for i in np.flatnonzero(odd & ~special).tolist():
            first, *rest = _PLAIN.split(texts[i].as_py())
            table = self._table(rest)
            out[i] = np.concatenate([self._raw([first])[0], np.frombuffer(b"".join([table[w] for w in rest]), self.dtype)])
        even = np.flatnonzero(~odd & ~special)
        if len(even):
            # split and number the pieces without making a Python string of each
            split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
            ends = split.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            numbered = split.flatten().dictionary_encode()
            number = numbered.indices.to_numpy().astype(np.int64)
            words = numbered.dictionary.to_pylist()
            # a text's first piece has no space before it
            firsts = [words[k] for k in number[ends[:-1]].tolist()]
            number[ends[:-1]] = len(words) + np.arange(len(even))
            inner = np.zeros(len(words), bool)
            inner[number[number < len(words)]] = True
            words = [w if used else None for w, used in zip(words, inner.tolist(), strict=True)]
            table = self._table([w for w in words if w is not None])
            blobs = [b"" if w is None else table[w] for w in words] + [x.tobytes() for x in self._raw(firsts)]
            ids = np.frombuffer(b"".join(blobs), self.dtype)
            size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // ids.itemsize
            start = np.cumsum(size) - size
            own = size[number]
            total = np.cumsum(own)
            ids = ids[np.repeat(start[number] - (total - own), own) + np.arange(int(total[-1]))]
            cuts = np.append(0, total)[ends]
            for i, a, b in zip(even.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out


@lru_cache(2)
def encoder(path: str, encode_special_tokens: bool = True) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path, encode_special_tokens)


def write_token_files(documents: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, encode_special_tokens: bool = True) -> DataFrame:
    """Encode every text by the tokenizer file ``vocabulary`` into the files of ``folder`` (a URI), and return its manifest.

    ``end_id`` is appended to each document. Null texts are empty and so hold the end id alone; rows with a null id are left out;
    repeated ids give a document for each row, in the order of a hash of their texts. Other columns are not read. Memory is bounded
    by a batch of texts, or one longer text: ids go to the file as they are made. An empty table has an empty manifest and no files. ``encode_special_tokens`` as for :class:`Encoder`.
    """
    spark = documents.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, encode_special_tokens)
        end = np.array([] if end_id is None else [end_id], e.dtype)
        name = f"{folder}/{uuid.uuid4().hex}"
        files, n, total, low = [], 0, 0, None
        for batch in split_batches(batches, limit=BATCH_BYTES):
            if not files:
                files = [create(f"{name}.{x}") for x in ("ids", "ends", "docs")]
                files[1].write(np.zeros(1, "<i8").tobytes())
                low = batch.column(0)[0].as_py()
            ids = e.encode(batch.column(1))
            ends = total + np.cumsum([len(x) + len(end) for x in ids])
            files[0].write(np.concatenate([y for x in ids for y in (x, end)]).tobytes())
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n, total = n + len(ids), int(ends[-1])
        for f in files:
            f.close()
        if files:
            yield pa.record_batch([pa.array([x]) for x in (name, e.dtype, low, n, total)], ["name", "dtype", "first_doc", "n_docs", "n_ids"])

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = texts(documents).where("doc_id IS NOT NULL").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, "name string, dtype string, first_doc long, n_docs long, n_ids long"), f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as unsigned 32-bit little-endian integers.
    The files are memory-mapped, so only the pages in use are held.
    """
    before = Window.orderBy("first_doc", "name").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids, ends, docs = mapped(f"{part['name']}.ids", part["dtype"]), mapped(f"{part['name']}.ends", "<i8"), mapped(f"{part['name']}.docs", "<i8")
                for at in range(0, len(docs), 4096):
                    e = np.asarray(ends[at : at + 4097])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
                    out = [pa.array(docs[at : at + 4096]), pa.array(e[:-1] + part["base"]), pa.array(np.diff(e)), pa.array(crc, pa.int64())]
                    if with_ids:
                        own = pa.array(ids[e[0] : e[-1]].astype(np.int64))
                        out.append(pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), own))
                    yield pa.record_batch(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    n = max(1, manifest.count())
    return manifest.repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(documents: DataFrame, vocabulary: str, end_id: int | None = 0, folder: str | None = None, encode_special_tokens: bool = True) -> DataFrame:
    """Write the files (in a new shared folder unless one is named) and read them back: a row for each row with an id, none for an empty table."""
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    write_token_files(documents, folder, vocabulary, end_id, encode_special_tokens)
    return read_token_files(spark, folder)
