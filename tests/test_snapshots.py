"""Versions of stored relations: one step for several tables, writers that die, writers that meet."""

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from lintweave.operators.snapshots import Conflict, Snapshots

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def stored(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_step(spark, stored):
    with stored.change() as c:
        c.replace("a", frame(spark, (1, "x"), (2, "y")))
        c.replace("b", frame(spark, (9, "z")))
        assert stored.versions() == []
    held = stored.read("a")
    with stored.change() as c:
        c.replace("a", frame(spark, (3, "n")).select("v", F.col("id").cast("int"), F.lit(0).alias("more")))
        c.add("b", frame(spark, (9, "z"), (8, None)))
        assert rows(stored.read("a")) == [(1, "x"), (2, "y")] and rows(c.read("a")) == [(3, "n")]
    assert c.version == 2 and rows(stored.read("a")) == [(3, "n")] and stored.read("a").schema == held.schema
    assert rows(held) == [(1, "x"), (2, "y")] == rows(stored.read("a", 1))
    assert sorted(map(str, stored.read("b").collect())) == sorted(map(str, frame(spark, (9, "z"), (9, "z"), (8, None)).collect()))
    with stored.change() as c:
        c.clear()
    assert rows(stored.read("a")) == rows(stored.read("b")) == [] and stored.read("a").columns == ["id", "v"]
    with stored.change() as c:
        c.add("a", frame(spark, (5, "q")))
        c.upsert("a", frame(spark, (5, "r"), (6, "s")), ["id"])
        c.ignore("a", frame(spark, (6, "no"), (7, "t")), ["id"])
        c.scoped("a", frame(spark, (9, "u")), F.col("id") < 6, ["id"])
    assert rows(stored.read("a")) == [(6, "s"), (7, "t"), (9, "u")]
    assert stored.vacuum(keep=1) >= 5 and stored.versions() == [4] and rows(stored.read("a")) == [(6, "s"), (7, "t"), (9, "u")]
    with pytest.raises(KeyError):
        stored.read("none")


def test_failed_change(spark, stored):
    with stored.change() as c:
        c.replace("a", frame(spark, (1, "x")))
    with pytest.raises(ZeroDivisionError), stored.change() as c:
        c.clear("a")
        c.add("a", frame(spark, (2, "y")))
        raise ZeroDivisionError
    assert stored.versions() == [1] and rows(stored.read("a")) == [(1, "x")]
    assert stored.vacuum() == 1 and rows(stored.read("a")) == [(1, "x")]


def test_two_writers(spark, stored):
    with stored.change() as c:
        c.replace("a", frame(spark, (1, "x")))
    one, two = stored.change(), stored.change()
    one.upsert("a", frame(spark, (1, "one")), ["id"])
    two.upsert("a", frame(spark, (1, "two")), ["id"])
    one.__exit__(None, None, None)
    with pytest.raises(Conflict):
        two.__exit__(None, None, None)
    assert rows(stored.read("a")) == [(1, "one")] and stored.versions() == [1, 2]
    assert not [x for x in os.listdir(stored.root.removeprefix("file://") + "/versions") if x.startswith(".") and not x.endswith(".crc")]


def test_killed_writer(spark, stored):
    """A process that is killed between the delete and the insert."""
    with stored.change() as c:
        c.replace("a", frame(spark, (1, "x")))
    code = f"""
import sys, time
from pyspark.sql import SparkSession
from lintweave.operators.snapshots import Snapshots
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
with Snapshots(spark, {stored.root!r}).change() as c:
    c.clear("a")
    c.add("b", spark.range(5))
    print("between", flush=True)
    time.sleep(600)
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": ROOT}
    with subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env, start_new_session=True) as writer:
        assert writer.stdout.readline().strip() == "between"
        os.killpg(writer.pid, signal.SIGKILL)
    time.sleep(0.2)
    assert stored.versions() == [1] and rows(stored.read("a")) == [(1, "x")] and stored.vacuum() == 1
