"""Scratch folders: named with their file system, and deleted by the scope that made them only."""

import os
import threading

from tally.sources import scratch


def test_folders_name_their_file_system(spark, tmp_path):
    assert scratch.qualified(spark, f"{tmp_path}/a/") == f"file:{tmp_path}/a"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
    try:
        assert scratch.qualified(spark, "/shared/x") == "viewfs://cluster/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_two_threads_keep_their_tables(spark):
    inside, done = threading.Barrier(2), threading.Barrier(2)
    local = lambda path: path.removeprefix("file:")
    seen = {}

    def work(name):
        with scratch.scope(spark, keep="kept-"):
            mine = [scratch.scratch_path(spark, f"{n}-{name}") for n in ("kept", "gone")]
            for p in mine:
                spark.range(1).write.parquet(p)
            inside.wait()
            if name == "b":
                done.wait()
                seen["b inside"] = [os.path.exists(local(p)) for p in mine]
        seen[name] = [os.path.exists(local(p)) for p in mine]
        if name == "a":
            done.wait()

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert seen == {"a": [True, False], "b": [True, False], "b inside": [True, True]}


def test_scopes_hand_on_what_they_keep(spark):
    with scratch.scope(spark, keep="none-"):
        with scratch.scope(spark, keep="kept-"):
            path = scratch.scratch_path(spark, "kept")
            spark.range(1).write.parquet(path)
        assert os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
