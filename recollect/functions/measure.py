"""Taking the time of calls, as rows for the statistics."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps


class Log:
    """Calls and how long they took: (operation, seconds)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    def timed(self, f: Callable) -> Callable:
        """f, noting every call under its name, failed ones too. A DataFrame that is returned isn't evaluated by that."""

        @wraps(f)
        def call(*args, **kwargs):
            begin = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                self.rows.append((f.__name__, time.perf_counter() - begin))

        return call

    def table(self, spark):
        return spark.createDataFrame(self.rows, "operation string, seconds double")
