"""Failed queue items come again, also after a restart; dead, repeated and unknown ones."""

import os
import time

import pytest

from millrace.streaming import retries as R

ITEMS = "id long, mode string, expr string"


def deliver(spark, folder, name, rows):
    """A file of items, moved in whole."""
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


@pytest.fixture
def store(spark):
    kept = spark.conf.get(R.STORE[0], None)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.unset(R.STORE[0]) if kept is None else spark.conf.set(R.STORE[0], kept)


def logged(folder):
    """An act that writes down each call and fails as the item says: 'f2' fails twice, 'x' always."""

    def act(key, mode, expr, tries):
        with open(f"{folder}/{key}-{tries}", "a") as f:
            f.write(f"{mode}\n")
        if expr == "raise":
            raise ValueError("no")
        return expr != "x" and tries > int(expr[1:])

    return act


def test_a_failed_item_comes_again_after_a_restart(spark, store, tmp_path):
    inbox, calls = str(tmp_path / "in"), tmp_path / "calls"
    os.makedirs(calls)
    deliver(spark, inbox, "a", [(1, "P", "f0"), (2, "P", "f2"), (3, "X", "x"), (4, "Z", "f0"), (5, None, "f0"), (6, "P", "raise"), (1, "P", "f0")])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: R.retrying(spark.readStream.schema(ITEMS).parquet(inbox), logged(str(calls)), ("P", "X"), wait_ms=1500, most=3)
    R.run_until(stream(), out, state, 3)  # what is settled at the first try; then the consumer stops
    first = {r.id: (r.tries, r.outcome) for r in spark.read.parquet(out).collect()}
    assert first == {1: (1, "done"), 4: (1, "unknown"), 5: (1, "unknown")}
    assert {f for f in os.listdir(calls) if f.startswith("2-")} <= {"2-1", "2-2"}
    deliver(spark, inbox, "b", [(1, "P", "f0"), (7, "P", "f1")])  # 1 once more
    R.run_until(stream(), out, state, 7)
    got = {r.id: (r.mode, r.tries, r.outcome) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("P", 1, "done"), 2: ("P", 3, "done"), 3: ("X", 3, "dead"), 4: ("Z", 1, "unknown"), 5: (None, 1, "unknown"), 6: ("P", 3, "dead"), 7: ("P", 2, "done")}
    assert spark.read.parquet(out).count() == 7
    assert open(calls / "1-1").read() == "P\n" and not (calls / "4-1").exists()
    waited = os.path.getmtime(calls / "2-3") - os.path.getmtime(calls / "2-2")
    assert waited >= 1.4


def test_settled_items_expire(spark, store, tmp_path):
    inbox, calls = str(tmp_path / "in"), tmp_path / "calls"
    os.makedirs(calls)
    deliver(spark, inbox, "a", [(1, "P", "f0")])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: R.retrying(spark.readStream.schema(ITEMS).parquet(inbox), logged(str(calls)), ("P",), wait_ms=500, most=3, keep_ms=1000)
    R.run_until(stream(), out, state, 1)
    time.sleep(1.2)
    deliver(spark, inbox, "b", [(1, "P", "f0")])
    R.run_until(stream(), out, state, 2)
    assert open(calls / "1-1").read() == "P\nP\n"


def test_a_queue_that_does_not_settle_is_an_error(spark, store, tmp_path):
    inbox, calls = str(tmp_path / "in"), tmp_path / "calls"
    os.makedirs(calls)
    deliver(spark, inbox, "a", [(1, "P", "x")])
    stream = R.retrying(spark.readStream.schema(ITEMS).parquet(inbox), logged(str(calls)), ("P",), wait_ms=60_000)
    with pytest.raises(TimeoutError):
        R.run_until(stream, str(tmp_path / "out"), str(tmp_path / "state"), 1, limit_s=4)


def test_a_bucket_keeps_its_items_apart(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 2)
    inbox, calls = str(tmp_path / "in"), tmp_path / "calls"
    os.makedirs(calls)
    expr = ("f0", "f1", "f2", "x")
    deliver(spark, inbox, "a", [(i, "P", expr[i % 4]) for i in (*range(40), *range(40))])
    out = str(tmp_path / "out")
    R.run_until(R.retrying(spark.readStream.schema(ITEMS).parquet(inbox), logged(str(calls)), ("P",), wait_ms=500, most=3), out, str(tmp_path / "state"), 40)
    got = sorted((r.id, r.tries, r.outcome) for r in spark.read.parquet(out).collect())
    assert got == [(i, min(i % 4 + 1, 3), "dead" if i % 4 == 3 else "done") for i in range(40)]
    assert {open(calls / f).read() for f in os.listdir(calls)} == {"P\n"}


def test_the_limit_is_one_of_standstill(spark, store, tmp_path):
    """Items that settle one after another take longer than the limit in all."""
    inbox = str(tmp_path / "in")
    deliver(spark, inbox, "a", [(i, "P", str(i)) for i in range(6)])
    stream = R.retrying(spark.readStream.schema(ITEMS).parquet(inbox), lambda key, mode, expr, tries: tries > key, ("P",), wait_ms=2500, most=9)
    began = time.monotonic()
    R.run_until(stream, str(tmp_path / "out"), str(tmp_path / "state"), 6, limit_s=9)
    assert time.monotonic() - began > 9
