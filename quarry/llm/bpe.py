"""Byte-level BPE encoding and decoding as a monoid reduction over a tree of text pieces.

A text is halved down to leaves; leaves are encoded on their own; two neighbours are joined by encoding anew
only a window around their border. The window grows until what lies outside can't change:

* The split pattern has certain borders: between a letter and another kind of character, between a
  digit and another kind, between a non-space and white space, and between a mark and a digit. No match spans one
  and no match looks past one, in any context; so the encoding of a concatenation at a certain border is the
  concatenation of the encodings. The window reaches to the next certain border on either side.
* Inside a long run of letters there is none. There the window is taken in tokens: a token
  sequence is the encoding of one match exactly if each two neighbours are the encoding of their bytes. A window encoded anew
  that begins and ends with the tokens that it had leaves all pairs outside, and those across its ends, as they were.

Whatever the windows can't settle is encoded whole, so the result is always that of encoding the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import split_batches, texts

#: Characters in a leaf of the tree.
LEAF = 4096
#: Ids in a leaf when decoding.
DECODE_LEAF = 1 << 10
#: Characters searched for a certain border at first, and at most.
WINDOW, MOST_WINDOW = 64, 4096

_BORDER = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
_LETTERS = regex.compile(r"\p{L}+")


class Codec:
    """The vocabulary of a rank file, ``pattern`` splitting the text before the merges."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, decode_leaf: int = DECODE_LEAF):
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("certain borders are known for the public pattern only")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf, self.decode_leaf = leaf, decode_leaf
        self.flat = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.flat.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        size = WINDOW
        while True:
            a, b = max(lo, mid - size), min(hi, mid + size)
            # a border at mid itself counts; those at a and b need their neighbours, so they are looked for inside
            found = [m.start() for m in _BORDER.finditer(text, a, b) if a < m.start() < b]
            before = max((x for x in found if x <= mid), default=lo if a == lo else None)
            after = min((x for x in found if x >= mid), default=hi if b == hi else None)
            if before is not None and after is not None:
                break
            if size >= MOST_WINDOW:
                joined = self._join_letters(text, lo, mid, hi, left, right)
                if joined is not None:
                    return joined
            size *= 2
        if before == mid or after == mid:
            return left + right
        return left[: self._back(left, len(text[before:mid].encode()))] + self.flat.encode_ordinary(text[before:after]) + right[self._forth(right, len(text[mid:after].encode())) :]

    def _join_letters(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """The same inside a run of letters, by windows of tokens; None if they don't settle within it."""
        m = _LETTERS.match(text, mid, min(hi, mid + MOST_WINDOW))
        room_right = len(text[mid : m.end()].encode()) if m else 0
        tail = text[max(lo, mid - MOST_WINDOW) : mid]
        k = len(tail)
        while k and tail[k - 1].isalpha() and _LETTERS.match(tail[k - 1]):
            k -= 1
        room_left = len(tail[k + 3 :].encode())  # a contraction can end within three characters of a mark
        n = 4
        while True:
            x, y = left[-n:], right[:n]
            if sum(len(self.bytes_of[i]) for i in x) > room_left or sum(len(self.bytes_of[i]) for i in y) > room_right:
                return None
            try:
                letters = b"".join(self.bytes_of[i] for i in (*x, *y)).decode()
            except UnicodeDecodeError:  # a token ends within a character
                if n >= len(left) and n >= len(right):
                    return None
                n += 1
                continue
            window = self.flat.encode_ordinary(letters)  # one match
            if window[0] == x[0] and window[-1] == y[-1]:
                return left[: len(left) - len(x)] + window + right[len(y) :]
            if n >= len(left) and n >= len(right):
                return None
            n *= 2

    def _back(self, ids: list[int], n_bytes: int) -> int:
        """How many ids are left when those of the last ``n_bytes`` go."""
        at = len(ids)
        while n_bytes > 0:
            at -= 1
            n_bytes -= len(self.bytes_of[ids[at]])
        assert n_bytes == 0
        return at

    def _forth(self, ids: list[int], n_bytes: int) -> int:
        at = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[at]])
            at += 1
        assert n_bytes == 0
        return at

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, joined up the same kind of tree."""
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= self.decode_leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self._decode(ids, lo, mid) + self._decode(ids, mid, hi)


@lru_cache(4)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


_KINDS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
_DDL = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_documents(documents: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Each document's byte-level BPE ids by the rank file ``vocabulary``, and what is decoded from them.

    ``columns`` are any of doc_id, n_tokens, ids, ids_sha256 (of the decimal ids joined by a space), decoded (bytes) and
    decoded_sha256. Null texts count as empty: no ids, no bytes. Ids of documents may be null or repeated, each row
    giving a row; other columns are not read; the table may be empty. No shuffle; a task holds one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in split_batches(batches):
            ids = [c.encode(x or "") for x in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0)}
            if "n_tokens" in columns:
                out["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
            if "ids" in columns:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array(x, np.int32) for x in ids])))
            if "ids_sha256" in columns:
                out["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(c.decimal.__getitem__, x)).encode()).hexdigest() for x in ids])
            if "decoded" in columns or "decoded_sha256" in columns:
                back = [c.decode(x) for x in ids]
                out["decoded"] = pa.array(back, pa.binary())
                out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in back])
            yield pa.record_batch([out[x].cast(_KINDS[x]) for x in columns], names=list(columns))

    return texts(documents).mapInArrow(run, ", ".join(f"{x} {_DDL[x]}" for x in columns))
