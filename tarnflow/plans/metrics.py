"""Counts and durations of queries, in the text form that metric scrapers read."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

# Upper ends of the duration buckets, in seconds.
BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0]


class Metrics:
    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.active = 0
        self.total: Counter[str] = Counter()
        self.failed: Counter[str] = Counter()
        self.seconds = 0.0
        self.counts = [0] * (len(BUCKETS) + 1)

    def begin(self, kind: str) -> None:
        with self.lock:
            self.active += 1
            self.total[kind] += 1

    def end(self, kind: str, seconds: float, failed: bool) -> None:
        with self.lock:
            self.active -= 1
            self.failed[kind] += failed
            self.seconds += seconds
            self.counts[bisect_left(BUCKETS, seconds)] += 1

    def text(self) -> str:
        with self.lock:
            lines = [f"tarnflow_queries_active {self.active}"]
            lines += [f'tarnflow_queries_total{{kind="{k}"}} {n}' for k, n in sorted(self.total.items())]
            lines += [f'tarnflow_queries_failed_total{{kind="{k}"}} {n}' for k, n in sorted(self.failed.items()) if n]
            so_far = 0
            for top, n in zip([*map(str, BUCKETS), "+Inf"], self.counts, strict=True):
                so_far += n
                lines.append(f'tarnflow_query_seconds_bucket{{le="{top}"}} {so_far}')
            lines += [f"tarnflow_query_seconds_sum {self.seconds:.6f}", f"tarnflow_query_seconds_count {so_far}"]
            return "\n".join(lines) + "\n"


METRICS = Metrics()


@contextmanager
def measured(kind: str, metrics: Metrics = METRICS) -> Iterator[None]:
    """Counts what runs inside, with its duration and whether it failed."""
    metrics.begin(kind)
    began, failed = time.perf_counter(), True
    try:
        yield
        failed = False
    finally:
        metrics.end(kind, time.perf_counter() - began, failed)
