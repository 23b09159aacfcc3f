"""Stages kept fresh by a stream against the batch status at the same time and of the same files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")  # of Spark's stateful Python streams

from datastrata.operators import freshness  # noqa: E402
from datastrata.streaming import stages as stream  # noqa: E402

ARRIVAL = "path string, md5 string, error string, seen timestamp"


def at(hour: int) -> dt.datetime:
    return dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)


def ntz(hour: int):
    return F.lit((at(hour)).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def model(spark):
    stage = "path string, cmd string, md5 string, side_effect boolean, fetch_schedule string, fetch_last_run timestamp_ntz, error string"
    start = dt.datetime(2024, 3, 1)
    rows = [(f"s{i}", "make", f"h{i}", i == 3, None, None, None) for i in range(6)]
    rows[1] = ("s1", "make", "h1", False, "daily", start, None)
    rows[2] = ("s2", "make", "h2", False, "0 9 * * *", start, None)
    rows[4] = ("s4", "make", "h4", False, "nonsense", start, None)
    rows[5] = ("s5", "make", "h5", False, "manual", start, "unreadable")
    stages = spark.createDataFrame(rows, stage)
    outs = spark.createDataFrame([(f"s{i}", 0, f"s{i}", f"h{i}") for i in range(6)] + [("s0", 1, "s0.log", "l0")], "stage string, ord int, path string, md5 string")
    deps = [(f"s{i}", 0, f"raw{i % 2}", f"r{i % 2}", "dep") for i in range(4)] + [("s1", 1, "s0", "h0", "dep"), ("s2", 1, "s1", "old", "dep")]
    deps = spark.createDataFrame(deps, "stage string, ord int, dep_path string, recorded string, kind string")
    return stages, outs, deps


def run(spark, folder, model, batches, files, late="1 hour"):
    for rows in batches:
        spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arrivals = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/in")
        seen = stream.replay(arrivals, f"{folder}/out", f"{folder}/state", *model, files, ntz(0), late=late)
    return seen


def rows_of(df):
    return sorted((r.stage, r.fresh, r.status, r.reason) for r in df.select("stage", "fresh", "status", "reason").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_replay_equals_batch(spark, tmp_path, model, seed):
    """Files come, change, fail and go, out of order and again, over restarts of the stream."""
    random.seed(seed)
    paths = ["s0", "s0.log", "s1", "s2", "s3", "s4", "raw0", "raw1", "of no stage"]
    good = {"s0.log": "l0", "raw0": "r0", "raw1": "r1"}
    state, batches = {}, []
    for turn in range(3):
        rows = []
        for path in paths:
            for _ in range(random.randint(0, 2)):
                what = random.choice([(good.get(path, f"h{path[1:]}"), None), ("other", None), (None, "no rights"), (None, None)])
                row = (path, *what, at(2 + 5 * turn) + dt.timedelta(seconds=random.randint(0, 1800)))
                if path not in state or (row[3], row[1] or "") >= (state[path][3], state[path][1] or ""):
                    state[path] = row
                rows.append(row)
        random.shuffle(rows)
        batches.append(rows)
    batches[-1] += batches[-1][:3]  # repeats
    batches[-1].append(("of no stage", "x", None, at(12)))
    first = spark.createDataFrame([("s0", "h0", None), ("raw1", "r1", None)], "path string, md5 string, error string")
    seen = run(spark, str(tmp_path), model, batches, first)
    files = {r.path: tuple(r) for r in first.collect()} | {p: r[:3] for p, r in state.items()}
    now = spark.createDataFrame([f for f in files.values() if f[1] or f[2]], "path string, md5 string, error string")
    want = freshness.freshness(*model, now, now=ntz(11))  # an hour behind the last arrival
    before = freshness.freshness(*model, first, now=ntz(0))
    assert rows_of(stream.latest(before, seen)) == rows_of(want)
    turns = [(r.stage, r.turn) for r in seen.collect()]
    assert len(turns) == len(set(turns))


def test_late_null_and_empty(spark, tmp_path, model):
    none = spark.createDataFrame([], "path string, md5 string, error string")
    come = [[("s0", "h0", None, at(5)), (None, "h0", None, at(5)), ("s0.log", "l0", None, None), ("x", "y", None, at(8))], [("s0.log", "l0", None, at(2)), ("raw0", "r0", None, at(8))]]
    seen = run(spark, str(tmp_path), model, come, none)
    now = {r[0]: r for r in rows_of(stream.latest(freshness.freshness(*model, none, now=ntz(0)), seen))}
    assert now["s0"] == ("s0", False, "missing", "output missing: s0.log")  # came too late, and without a time
    assert now["s3"][2] == "missing" and now["s5"][3] == "unreadable"
    empty = tuple(d.limit(0) for d in model)
    assert rows_of(run(spark, f"{tmp_path}/empty", empty, [[("s0", "h0", None, at(5))]], none)) == []


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), stream.state_store(spark):
        assert spark.conf.get(key) == stream.PROVIDER
        1 / 0
    assert spark.conf.get(key) == old
