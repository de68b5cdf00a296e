"""Wall-clock seconds of the stages of a run: load, convert, run."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

log = logging.getLogger("spindrift")


class Stages:
    """``with stages("load"): ...`` adds up the seconds of each name and logs them."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        begin = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - begin
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            log.info("%s: %.3f s", name, took)


def drained(df: DataFrame) -> None:
    """Computes every row of ``df`` and keeps none: makes a lazy stage measurable."""
    df.write.format("noop").mode("overwrite").save()
