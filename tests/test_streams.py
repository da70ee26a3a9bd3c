"""Running queries must give what their batch form gives."""

import json

import pandas as pd

from __spark_entry__ import queries
from martspark.operators.ratelimit import rate_limited
from martspark.session import working_path
from martspark.sources import streams
from martspark.streaming import windows

FOLDER = "/root/testdata/sf0.001"


def test_streamed_rate_limit_equals_batch(spark):
    batch = sorted(map(tuple, queries()["r12_rate_limited"](spark, FOLDER).collect()))
    stream = sorted(map(tuple, queries()["r12_streamed_rate_limit"](spark, FOLDER).collect()))
    assert batch == stream
    assert any(not row[-1] for row in batch)


SCHEMA = "request_id long, ts timestamp, endpoint string, client long, latency double"


def rows_at(first_id, client, seconds):
    return [(first_id + k, (pd.Timestamp("2001-01-01") + pd.Timedelta(seconds=s)).to_pydatetime(), "e", client, 1.0)
            for k, s in enumerate(seconds)]


def test_rate_limit_over_batches_with_a_late_request(spark):
    """Three batches, the second with a request older than what the first held; silent clients leave no state."""
    batches = [
        rows_at(0, 1, [0, 10, 50, 55]) + rows_at(100, 2, [0.5, 0.5, 0.5]),
        rows_at(10, 1, [5, 70, 71]) + rows_at(110, 3, [65]),  # 5 s is late, but inside the allowed lateness
        rows_at(20, 1, [115, 400]) + rows_at(120, 2, [300, 301, 302]),
        rows_at(900, 9, [100_000]), rows_at(901, 9, [200_000]),
    ]
    path, out, checkpoint = (working_path(spark, name) for name in ("requests", "limited", "limited-checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        live = streams.parquet_stream(spark, path, schema, files_per_trigger=1)
        with windows.rocks_state(spark):
            query = windows.run_to_table(windows.rate_limited_stream(live, 2, 60, "2 minutes"), out, checkpoint)
            query.awaitTermination()
    everything = spark.createDataFrame([row for batch in batches for row in batch], SCHEMA)
    expected = {r.request_id: r.accepted for r in rate_limited(everything, 2, 60).collect()}
    got = spark.read.parquet(out).collect()
    assert len(got) == len({r.request_id for r in got})
    assert {r.request_id: r.accepted for r in got} == {k: v for k, v in expected.items() if k != 901}
    assert not all(expected.values())
    progress = json.loads(query.lastProgress.json)
    assert progress["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) >= 0
    state = spark.read.format("statestore").option("stateVarName", "accepted").option("flattenCollectionTypes", "true").load(checkpoint)
    assert {r.key.client for r in state.collect()} <= {9}
