"""Times of queries, slow ones first, and which fields their filters name."""

from __future__ import annotations

import re
import statistics
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quern.plans.explain import explain


@dataclass
class Profiler:
    slow_seconds: float = 1.0
    runs: list[tuple[str, float, int | None]] = field(default_factory=list)
    filters: Counter = field(default_factory=Counter)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        self.runs.append((name, time.perf_counter() - start, None))

    def rows(self, name: str, df: DataFrame) -> list:
        """Runs a query and keeps its time and row count."""
        self.filters.update(filtered_fields(df))
        start = time.perf_counter()
        out = df.collect()
        self.runs.append((name, time.perf_counter() - start, len(out)))
        return out

    def slow(self) -> list[tuple[str, float, int | None]]:
        return sorted((r for r in self.runs if r[1] >= self.slow_seconds), key=lambda r: -r[1])

    def statistics(self) -> dict[str, float]:
        times = [r[1] for r in self.runs]
        return {"count": len(times), "total": sum(times), "mean": statistics.fmean(times) if times else 0.0, "max": max(times, default=0.0)}

    def advice(self, least: int = 2) -> list[str]:
        """Fields to sort or partition files by: those that filters name most."""
        return [f for f, n in self.filters.most_common() if n >= least]


def filtered_fields(df: DataFrame) -> set[str]:
    """Columns in the filters that reach a scan."""
    out = set()
    for pushed in re.findall(r"PushedFilters: \[([^\n]*)\]", explain(df)):
        out |= set(re.findall(r"\w+\((\w+)", pushed))
    return out - {"Not", "Or", "And"}
