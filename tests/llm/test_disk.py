"""Files on disk: those of finished steps go while a job runs."""

import os
import time

import pytest

from lakeglean.operators import components


@pytest.fixture
def files(spark, monkeypatch):
    """Sizes of the session's shuffle files as they were at each cut, in order."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    now = lambda: {f: os.path.getsize(f) for f in folders.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and os.path.exists(f)}
    at, real = [now()], components.cut

    def cut(df):
        out = real(df)
        at.append(now())
        return out

    monkeypatch.setattr(components, "cut", cut)
    return at, now


def test_files_of_finished_rounds_go(spark, files):
    at, now = files
    found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long"))
    assert len(at) > 6
    made = set().union(*at[: len(at) // 2]) - set(at[0])
    until = time.time() + 20
    while (left := made & set(now())) and time.time() < until:
        time.sleep(0.5)
    assert made and not left
    assert {r.component for r in found.collect()} == {0}
