"""Counters of streaming queries as text that a scraper reads."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds in seconds of the histogram of batch times.
BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 60.0)


class Metrics(StreamingQueryListener):
    """Adds up the progress of every streaming query of a session; add it with spark.streams.addListener."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.buckets: dict[str, list[int]] = {}
        self.seconds: dict[str, float] = {}
        self.failed = self.running = 0

    def observe(self, query: str, rows: int, seconds: float) -> None:
        self.rows[query] = self.rows.get(query, 0) + rows
        self.batches[query] = self.batches.get(query, 0) + 1
        self.seconds[query] = self.seconds.get(query, 0.0) + seconds
        self.buckets.setdefault(query, [0] * (len(BOUNDS) + 1))[bisect_left(BOUNDS, seconds)] += 1

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.observe(p.name or str(p.id), p.numInputRows, (p.batchDuration or 0) / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
        self.failed += event.exception is not None

    def text(self) -> str:
        out = ["# TYPE streaming_queries gauge", f"streaming_queries {self.running}", "# TYPE streaming_failures_total counter", f"streaming_failures_total {self.failed}"]
        for name, values in (("ingested_rows_total", self.rows), ("batches_total", self.batches)):
            out.append(f"# TYPE {name} counter")
            out += [f'{name}{{query="{q}"}} {n}' for q, n in sorted(values.items())]
        out.append("# TYPE batch_seconds histogram")
        for q, counts in sorted(self.buckets.items()):
            total = 0
            for bound, n in zip((*BOUNDS, "+Inf"), counts, strict=True):
                total += n
                out.append(f'batch_seconds_bucket{{query="{q}",le="{bound}"}} {total}')
            out += [f'batch_seconds_sum{{query="{q}"}} {self.seconds[q]:g}', f'batch_seconds_count{{query="{q}"}} {total}']
        return "\n".join(out) + "\n"
