"""Live figures from progress reports."""

from types import SimpleNamespace

import pytest

from tidewarden.streaming import live


def report(batch, n, counts, sources, rate=5.0):
    seen = None if counts is None else {"timed": counts[-1], **{f"le_{i}": c for i, c in enumerate(counts[:-1])}}
    return SimpleNamespace(name="q", batchId=batch, numInputRows=n, processedRowsPerSecond=rate, sources=[SimpleNamespace(latestOffset=a, endOffset=b) for a, b in sources],
                           observedMetrics={} if seen is None else {"live": seen})


def test_rows_of_progress(spark):
    log = [('{"t":{"0":50,"1":9}}', '{"t":{"0":40,"1":9}}'), ("null", '{"logOffset": 3}'), ("{'logOffset': 7}", "{'logOffset': 5}"), (None, None)]
    reports = [report(0, 8, [2, 4, 6], log), report(1, 0, [0, 0, 0], []), report(2, 3, None, []), report(3, 4, [0, 0, 0], [], None)]
    rows = live.live_rows(reports, [0.5, 1.0])
    assert rows == [("q", 0, 8, 5.0, 6, [2, 4], 12), ("q", 3, 4, None, 0, [0, 0], 0)]
    got = {r.batch_id: (r.p50_ms, r.p95_ms) for r in live.live_metrics(spark.createDataFrame(rows, live.LIVE), [0.5, 1.0]).collect()}
    assert got == {0: (pytest.approx(750.0), 1000.0), 3: (None, None)}
