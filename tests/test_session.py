"""Work folders: where they are, who owns them, and when they go."""

from __future__ import annotations

import gc
import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recordloom import session


def freed(spark, path: str) -> bool:
    """Whether the folder goes once nothing reads it; the JVM may need several collections."""
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        session.sweep(spark)
        if path not in session._used:
            return True
        time.sleep(0.2)
    return False


def exists(spark, path: str) -> bool:
    fs, p = session._folder(spark, path)
    return fs.exists(p)


def test_folder_lives_as_long_as_a_derived_frame(spark):
    with session.watched() as made:
        d = session.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    path = made[0]
    derived = d.select("k").where("k > 2")
    del d
    assert not freed(spark, path) and derived.count() == 4
    del derived
    assert freed(spark, path) and not exists(spark, path)


def test_discard_is_at_once(spark):
    with session.watched() as made:
        d = session.materialize(spark.range(3).toDF("a"))
    session.discard(spark, d)
    assert not exists(spark, made[0]) and made[0] not in session._used


def test_watched_folders_are_of_one_thread(spark):
    seen = {}

    def work(name):
        with session.watched() as made:
            session.work_dir(spark)
            time.sleep(0.3)
            seen[name] = list(made)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen["a"]) == len(seen["b"]) == 1 and seen["a"] != seen["b"]


def test_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    monkeypatch.setattr(session, "_used", {})
    conf = SimpleNamespace(get=lambda k, d=None: d)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_settings_come_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    session.materialize(spark.range(5).repartition(3))
    assert spark.conf.get(name) == before
