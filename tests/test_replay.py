"""The replay in the state store: restarts, late labels, windows and cycles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.streaming.replay import label_replay

SCHEMA = "line string, seq long, kind string, id long, q int, response int, ts timestamp"
T0 = dt.datetime(2024, 1, 1)
FILES = 9


def events():
    """Scores of file k; their labels come one file later, those of every fifth id six files later, and one before its score."""
    files = [[] for _ in range(FILES)]
    for n in range(60):
        k, line = n // 10, "ab"[n % 2]
        files[k].append((line, n, "score", n, 9000 if n % 3 else 100, None, T0 + dt.timedelta(hours=k)))
        j = k + 6 if n % 5 == 0 else max(0, k - 1) if n == 33 else k + 1
        if j < FILES:
            files[j].append((line, n, "label", n, None, n % 2 if n % 4 else 1, T0 + dt.timedelta(hours=j)))
    files.append([(x, 0, "tick", 0, None, None, T0 + dt.timedelta(hours=20)) for x in "ab"])
    files.append([(x, 0, "tick", 0, None, None, T0 + dt.timedelta(hours=21)) for x in "ab"])
    return files


def plain():
    out = []
    for line in "ab":
        own = [n for n in range(60) if "ab"[n % 2] == line]
        for cycle, a in enumerate(range(0, 30, 13)):
            for w, b in enumerate(range(a, min(a + 13, 30), 5)):
                rows = own[b : min(b + 5, a + 13, 30)]
                if len(rows) < min(5, 13 - 5 * w):
                    continue
                known = [(n % 3 != 0, (n % 2 if n % 4 else 1) == 1) for n in rows if n % 5]
                out.append((line, 3 * cycle + w, cycle, w, len(rows), len(known), *[sum(k == x for k in known) for x in ((True, True), (True, False), (False, True), (False, False))]))
    return sorted(out)


@pytest.mark.parametrize("breaks", [(11,), (3, 7, 11), (1, 2, 3, 4, 5, 6, 8, 10, 11)])
def test_restarts_change_nothing(spark, tmp_path, breaks):
    base, files, done = f"file://{tmp_path}", events(), 0
    for upto in breaks:
        for k in range(done, upto):
            spark.createDataFrame(files[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        done = upto
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        got = label_replay(stream, width=5, cycle_rows=13, late="2 hours")
        got.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").select("line", "run_seq", "cycle_id", "window", "rows", "labelled", "tp", "fp", "fn", "tn")
    assert sorted(map(tuple, rows.collect())) == plain()
    assert rows.agg(F.sum("labelled")).first()[0] < rows.agg(F.sum("rows")).first()[0]
