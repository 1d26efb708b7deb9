"""Searches of which the latest wins, and polling for what runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fingerprint


class LatestSearch:
    """Runs searches on threads of their own; a new one interrupts the one before, whose result is dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.generation, self.lock = spark, 0, threading.Lock()

    def start(self, search: Callable[[], list], done: Callable[[list], None]) -> threading.Thread:
        with self.lock:
            if self.generation:
                self.spark.interruptTag(f"search-{self.generation}")
            self.generation += 1
            mine = self.generation

        def run() -> None:
            self.spark.addTag(f"search-{mine}")
            try:
                rows = search()
            except Exception:
                if mine == self.generation:
                    raise
                return  # interrupted
            finally:
                self.spark.removeTag(f"search-{mine}")
            with self.lock:
                if mine == self.generation:
                    done(rows)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread


def changes(processes: Callable[[], DataFrame], every: float = 3.0, rounds: int | None = None) -> Iterator[DataFrame]:
    """The processes whenever their set has changed since the last look."""
    last = object()
    while rounds is None or rounds > 0:
        now = processes()
        mark = now.agg(fingerprint(F.col("pid"))).first()[0]
        if mark != last:
            last = mark
            yield now
        rounds = None if rounds is None else rounds - 1
        if rounds != 0:
            time.sleep(every)
