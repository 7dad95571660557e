"""What surrounds the engine: packages, answers to requests, typed tool calls, model processes and logging. Nothing here touches rows at scale."""

from __future__ import annotations

import html
import json
import logging
import os
import re
import shutil
import subprocess
import tarfile
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import zstandard

from ..sources.interchange import sha256_file
from .validate import safe_path

#: Bytes of a part of a download.
PART_BYTES = 64 << 20


def revision(text: str) -> tuple[str, bool]:
    """(identifier, whether the checkout has changes of its own) of a revision as version control prints it."""
    text = text.strip()
    if not re.fullmatch(r"[0-9a-f]{6,40}\+?", text):
        raise ValueError(f"no revision: {text!r}")
    return text.removesuffix("+"), text.endswith("+")


def download(fetch: Callable[[int, int], bytes], size: int, sha256: str, target: str, part: int = PART_BYTES) -> None:
    """Fetch ``size`` bytes by ranges ``fetch(first, end)`` into ``target``. What an earlier attempt left in ``target.part`` is kept; the digest decides."""
    temp = f"{target}.part"
    with open(temp, "ab") as f:
        while (at := f.tell()) < size:
            data = fetch(at, min(size, at + part))
            if not data:
                raise OSError("the download ended early")
            f.write(data)
            f.flush()
    if os.path.getsize(temp) != size or sha256_file(temp) != sha256:
        os.unlink(temp)
        raise ValueError("the download is not what its digest says")
    os.replace(temp, target)


def package(folder: str, target: str, level: int = 3) -> str:
    """A folder as a zstandard-compressed archive of plain files in order of their names; its SHA-256."""
    if os.path.exists(target):
        raise FileExistsError(target)
    names = sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, files in os.walk(folder) for n in files)
    with open(f"{target}.tmp", "wb") as f, zstandard.ZstdCompressor(level=level).stream_writer(f) as z, tarfile.open(fileobj=z, mode="w|") as tar:
        for n in names:
            tar.add(os.path.join(folder, n), n)
    os.replace(f"{target}.tmp", target)
    return sha256_file(target)


def unpack(archive: str, target: str) -> list[str]:
    """Files of an archive below ``target``, which is new. Anything but plain files and folders with plain relative names raises, and nothing is left."""
    if os.path.exists(target):
        raise FileExistsError(target)
    temp, out = f"{target}.tmp", []
    try:
        with open(archive, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as z, tarfile.open(fileobj=z, mode="r|") as tar:
            for member in tar:
                if member.isdir():
                    continue
                if not member.isfile() or not safe_path(member.name):
                    raise ValueError(f"unsafe member: {member.name}")
                path = os.path.join(temp, member.name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as g:
                    shutil.copyfileobj(tar.extractfile(member), g, 1 << 20)
                out.append(member.name)
        os.makedirs(temp, exist_ok=True)
        os.rename(temp, target)
        return out
    except BaseException:
        shutil.rmtree(temp, ignore_errors=True)
        raise


def resolve(folders: Iterable[str], name: str) -> str:
    """The one package of that name below the folders; none or several raise."""
    found = [p for f in folders for p in (os.path.join(f, name), os.path.join(f, f"{name}.tar.zst")) if os.path.exists(p)]
    if len(found) != 1:
        raise LookupError(f"{len(found)} packages of the name {name}")
    return found[0]


class NotFound(Exception):
    """Something asked for isn't there."""


class NotAllowed(Exception):
    """A host or a method that isn't served."""


class Unavailable(Exception):
    """Nothing is published yet."""


def respond(handler: Callable[[], object], method: str = "GET", host_allowed: bool = True) -> tuple[int, str]:
    """(status, JSON) of a request: the handler's value, or ``{"error": ...}`` with 400, 403, 404, 405, 500 or 503."""
    try:
        if method not in ("GET", "HEAD"):
            return 405, json.dumps({"error": f"method not allowed: {method}"})
        if not host_allowed:
            raise NotAllowed("unknown host")
        return 200, json.dumps(handler(), sort_keys=True, ensure_ascii=False)
    except ValueError as e:
        status, text = 400, str(e)
    except NotAllowed as e:
        status, text = 403, str(e)
    except NotFound as e:
        status, text = 404, str(e)
    except Unavailable as e:
        status, text = 503, str(e)
    except Exception as e:
        logging.getLogger("quarry").exception("request failed")
        status, text = 500, type(e).__name__
    return status, json.dumps({"error": text}, ensure_ascii=False)


def source_page(title: str, text: str, first: int, last: int) -> str:
    """A page of a source with its lines numbered and those from ``first`` to ``last`` marked."""
    rows = []
    for n, line in enumerate(text.split("\n"), 1):
        row = f'<span id="L{n}">{n:>5}  {html.escape(line)}</span>'
        rows.append(f"<mark>{row}</mark>" if first <= n <= last else row)
    name = html.escape(title)
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{name}</title></head><body><h1>{name}</h1><pre>\n' + "\n".join(rows) + "\n</pre></body></html>\n"


def logged(name: str, path: str) -> logging.Logger:
    """A logger of progress that writes to the console and to a file."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    return log


@dataclass(frozen=True)
class Tool:
    """A search as a tool for agents: typed arguments in, short results out."""

    search: Callable[..., list[dict]]
    fields: tuple[str, ...] = ("id", "entry", "src", "distance")
    most: int = 50
    chars: int = 2000

    #: Argument: type, and whether it may be left out.
    ARGUMENTS = {"query": (str, False), "limit": (int, True), "entries": (list, True), "sessions": (list, True)}

    def __call__(self, arguments: dict) -> dict:
        for name, (kind, optional) in self.ARGUMENTS.items():
            if name not in arguments:
                if not optional:
                    raise ValueError(f"missing argument: {name}")
            elif not isinstance(arguments[name], kind) or isinstance(arguments[name], bool):
                raise ValueError(f"{name} has to be of type {kind.__name__}")
        if unknown := sorted(set(arguments) - set(self.ARGUMENTS)):
            raise ValueError(f"unknown arguments: {', '.join(unknown)}")
        limit = min(arguments.get("limit", 10), self.most)
        found = self.search(**(arguments | {"limit": limit + 1}))
        shown = [{k: r[k][: self.chars] if isinstance(r.get(k), str) else r.get(k) for k in self.fields} for r in found[:limit]]
        return {"results": shown, "more": len(found) > limit}


class Managed:
    """A model server as a child process: started, waited for until ``ready()``, and ended with the block."""

    def __init__(self, command: list[str], ready: Callable[[], bool], seconds: float = 60.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.command, self.ready, self.seconds, self.sleep, self.clock = command, ready, seconds, sleep, clock
        self.process: subprocess.Popen | None = None

    def __enter__(self) -> Managed:
        self.process = subprocess.Popen(self.command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        began = self.clock()
        while not self.ready():
            if self.process.poll() is not None or self.clock() - began > self.seconds:
                self.__exit__()
                raise Unavailable("the server did not start")
            self.sleep(0.1)
        return self

    def __exit__(self, *_) -> None:
        if self.process is not None and self.process.poll() is None:
            self.process.terminate()
            try:
                self.process.wait(10)
            except subprocess.TimeoutExpired:
                self.process.kill()
                self.process.wait()
