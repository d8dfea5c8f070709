"""Restart of streaming queries that fail (section 2.10 Retry)."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Remembers, per query, the last batch that was committed."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.batches[str(event.progress.id)] = event.progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query_id: str) -> int:
        with self.lock:
            return self.batches.get(query_id, -1)


def supervise(spark: SparkSession, starters: list[Callable[[], StreamingQuery]], max_restarts: int = 5, backoff: float = 5.0,
              longest: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run queries until all have ended; a failed one is started again from its checkpoint.  Returns the restarts.

    Before a restart the pause doubles, from ``backoff`` up to ``longest``
    seconds.  A query that fails more than ``max_restarts`` times in a row
    without committing a batch in between stops the others and raises its error.
    """
    progress = Progress()
    spark.streams.addListener(progress)
    running = [{"start": s, "query": s(), "failed": 0, "seen": -1} for s in starters]
    restarts = 0
    try:
        while running:
            for r in list(running):
                try:
                    if r["query"].awaitTermination(1):
                        running.remove(r)
                except StreamingQueryException:
                    now = progress.of(str(r["query"].id))
                    r["failed"] = 1 if now > r["seen"] else r["failed"] + 1
                    r["seen"] = now
                    if r["failed"] > max_restarts:
                        raise
                    sleep(min(longest, backoff * 2 ** (r["failed"] - 1)))
                    restarts += 1
                    r["query"] = r["start"]()
    finally:
        for r in running:
            if r["query"].isActive:
                r["query"].stop()
        spark.streams.removeListener(progress)
    return restarts
