"""Files of our own formats in the shared folder, written and read by executors."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs


def local_path(uri: str) -> str | None:
    """The path of a file URI: a folder that is mounted on every machine can be opened and memory-mapped; None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    path = local_path(uri)
    return (pafs.LocalFileSystem(), path) if path is not None else pafs.FileSystem.from_uri(uri)


def create(uri: str):
    """A binary output stream; folders are made as needed."""
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def opened(uri: str) -> pa.NativeFile:
    """Random access for reading: a memory map where there is a path, ranged reads elsewhere."""
    path = local_path(uri)
    if path is not None:
        return pa.memory_map(path) if os.path.getsize(path) else pa.BufferReader(b"")
    store, path = _store(uri)
    return store.open_input_file(path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The whole file as an array: memory-mapped where there is a path, read elsewhere."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with opened(uri) as f:
        return np.frombuffer(f.read(), dtype=dtype)
