"""A live index, and incremental building from a stream of source blocks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources import interchange


class Live:
    """Follows the pointer of an index: each use sees one generation; one that can't be opened leaves the last good one in use."""

    def __init__(self, spark: SparkSession, index: str):
        self.spark, self.index, self.good = spark, index, None

    @contextmanager
    def held(self, kind: str) -> Iterator[DataFrame]:
        """A corpus whose generation stays until the block ends, also if another one is published and old ones are pruned meanwhile."""
        path, df = self._opened(kind)
        mark = interchange.lease(path)
        try:
            yield df
        finally:
            interchange.release(path, mark)

    def corpus(self, kind: str) -> DataFrame:
        return self._opened(kind)[1]

    def _opened(self, kind: str) -> tuple[str, DataFrame]:
        try:
            path = interchange.current(self.index)
            df = interchange.open_corpus(self.spark, path, kind)
            self.good = path
            return path, df
        except Exception:
            if self.good is None:
                raise
            return self.good, interchange.open_corpus(self.spark, self.good, kind)


class Refreshed:
    """A value that is computed anew at most every ``seconds``; a failure keeps the last one."""

    def __init__(self, compute: Callable[[], object], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.compute, self.seconds, self.clock = compute, seconds, clock
        self.at, self.value = None, None

    def get(self):
        if self.at is None or self.clock() - self.at >= self.seconds:
            try:
                self.value = self.compute()
            except Exception:
                if self.at is None:
                    raise
            self.at = self.clock()
        return self.value


def incremental(blocks: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``update`` on the new rows of a streaming ``blocks`` and stop when all there are have been taken.

    The keyed stores make an update that is run again after a failure compute nothing twice.
    """
    return blocks.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_store(blocks: DataFrame, checkpoint: str, store: Store, compute: Callable[[DataFrame], DataFrame], name: str, keep: Column | None = None, after: Callable[[int], None] = lambda _: None) -> StreamingQuery:
    """Fill a keyed store from a stream of ``blocks(key, ...)``, a commit a batch called by ``name`` and the batch's number.

    A batch that was committed, but not noted by the stream before it stopped, is run again and adds nothing. ``after`` runs after each commit.
    """

    def update(batch: DataFrame, number: int) -> None:
        store.fill(batch, compute, keep, f"{name}-{number}")
        after(number)

    return incremental(blocks, checkpoint, update)


class Updates:
    """An update loop driven by changes: a state is taken once, a failed one again after ``pause`` seconds or when the state changes."""

    def __init__(self, state: Callable[[], str], update: Callable[[str], None], pause: float = 86400.0, clock: Callable[[], float] = time.monotonic):
        self.state, self.update, self.pause, self.clock = state, update, pause, clock
        self.done: str | None = None
        self.failed: tuple[str, float] | None = None

    def step(self) -> str:
        """``current``, ``waiting``, ``updated`` or ``failed``."""
        now = self.state()
        if now == self.done:
            return "current"
        if self.failed is not None and self.failed[0] == now and self.clock() - self.failed[1] < self.pause:
            return "waiting"
        try:
            self.update(now)
        except Exception:
            self.failed = (now, self.clock())
            return "failed"
        self.done, self.failed = now, None
        return "updated"
