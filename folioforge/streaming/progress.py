"""Progress events of streams, deadlines and retries (ST03, ST05, ST10)."""
from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

T = TypeVar("T")


class Progress(StreamingQueryListener):
    """Keeps the number of rows and the state of each stream; ``seen`` is called with every event (ST03)."""

    def __init__(self, seen: Callable[[str, dict], None] | None = None) -> None:
        self.rows: dict[str, int] = {}
        self.state: dict[str, str] = {}
        self.seen = seen or (lambda kind, event: None)

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = "running"
        self.seen("started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + int(p.numInputRows)
        self.seen("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.seen("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.state[str(event.id)] = "failed" if event.exception else "ended"
        self.seen("terminated", {"id": str(event.id), "error": event.exception})


def with_retry(call: Callable[[], T], retry: Callable[[Exception], bool], times: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; after an error that may pass it is tried again, each wait twice the one before (ST10)."""
    for attempt in range(times):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == times or not retry(e):
                raise
            sleep(first_wait * 2 ** attempt)
    raise ValueError("times must be at least 1")


def within(spark: SparkSession, seconds: float, group: str, run: Callable[[], T]) -> T:
    """Run jobs that are cancelled when the deadline has passed (ST05)."""
    import threading
    sc = spark.sparkContext
    sc.setJobGroup(group, group, True)
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
