import os
import threading

import pytest
from pyspark.sql import functions as F

from plainlens.sources import listing, snapshots


def folders(path):
    return sorted(x for x in os.listdir(path) if x.startswith("data-"))


def test_snapshots_by_format(spark, tmp_path):
    spark.dataSource.register(snapshots.SnapshotSource)
    at = str(tmp_path / "t")
    write = lambda df, mode: df.write.format("snapshot").option("path", at).mode(mode).save()
    read = lambda **o: spark.read.format("snapshot").options(path=at, **o).load()
    write(spark.createDataFrame([(i, f"é{i}", [i], None) for i in range(50)], "id long, t string, a array<int>, n double").repartition(3), "append")
    write(spark.createDataFrame([(99, "x", None, 1.5)], "id long, t string, a array<int>, n double"), "append")
    assert snapshots.versions(at) == [1, 2] and read().count() == 51 and read(version=1).count() == 50
    assert tuple(read().filter("id = 99").first()) == (99, "x", None, 1.5) and read().filter("id = 7").first().a == [7]
    narrow = spark.read.format("snapshot").schema("t string").option("path", at).load()
    assert narrow.columns == ["t"] and narrow.filter("t = 'x'").count() == 1
    write(read().filter("id < 5"), "overwrite")
    assert read().count() == 5 and read(version=2).count() == 51 and snapshots.read_version(spark, at).count() == 5
    with pytest.raises(Exception, match="another schema"):
        write(spark.range(1), "append")
    assert snapshots.expired(at) and snapshots.versions(at) == [3] and read().count() == 5 and len(folders(at)) == 1
    write(read().limit(0), "overwrite")
    assert read().count() == 0 and snapshots.read_version(spark, at).columns == ["id", "t", "a", "n"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(snapshots.SnapshotSource)
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.range(4), at)
    before = folders(at)
    broken = spark.range(0, 200, 1, 4).withColumn("id", F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception):
        broken.write.format("snapshot").option("path", at).mode("append").save()
    with pytest.raises(Exception):
        snapshots.replace_table(broken, at)
    assert folders(at) == before and snapshots.versions(at) == [1] and snapshots.read_version(spark, at).count() == 4


def test_two_writers_from_one_version(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.range(1), at)
    late = snapshots._Writer(at, spark.range(1).schema, True)  # both start from version 1
    adding = snapshots._Writer(at, spark.range(1).schema, False)
    batch = spark.range(7).toArrow().to_batches()
    written, added = late.write(iter(batch)), adding.write(iter(batch))
    assert snapshots.replace_table(spark.range(3), at) == 2
    with pytest.raises(snapshots.Conflict):
        late.commit([written])
    late.abort([written])
    adding.commit([added])
    assert snapshots.versions(at) == [1, 2, 3] and snapshots.read_version(spark, at).count() == 10
    assert late.folder not in folders(at)


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.range(0), at)
    won, lost = [], []

    def add(k):
        try:
            won.append((snapshots.publish(at, 1, [f"data-{k}/x.parquet"], "{}", k % 2 == 0), k))
        except snapshots.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(v for v, _ in won) == list(range(2, 2 + len(won))) and len(won) + len(lost) == 12 and all(k % 2 for k in lost)
    last = snapshots.content(at)["files"]
    kept = [k for v, k in sorted(won)]
    start = max([i for i, k in enumerate(kept) if k % 2], default=-1)  # a replacement drops what was before it
    assert [f for f in last if "/x." in f] == [f"data-{k}/x.parquet" for k in kept[max(start, 0) :]]


def test_listing(spark, tmp_path):
    log = str(tmp_path / "log")

    def factory():
        def fetch(letter, page):
            with open(log, "a") as f:
                f.write(f"{letter}{page}\n")
            if letter == "b" and page == 2 and open(log).read().count("b2") == 1:
                raise ConnectionError("once")
            if letter == "c" and page == 2:
                raise ValueError("always")
            last = {"a": 2, "b": 3, "c": 9, "d": 0}[letter]
            entries = [{"nomeProduto": f"{letter}{page}{k}", "idBulaPacienteProtegido": None if k else f"i{page}"} for k in range(2)] if page <= last else []
            return {"content": entries, "totalPages": last} if letter != "b" else {"content": entries}

        return fetch

    spark.dataSource.register(listing.listing_source(factory))
    df = spark.read.format("paged_listing").options(letters="a,b,c,d", wait=0, tries=2).load()
    assert df.rdd.getNumPartitions() == 4
    got = df.collect()
    assert sorted(r.nomeProduto for r in got if r.nomeProduto) == ["a10", "a11", "a20", "a21", "b10", "b11", "b20", "b21", "b30", "b31", "c10", "c11"]
    assert [(r.letter, r.page, r.error) for r in got if r.error] == [("c", 2, "ValueError: always")]
    assert {(r.letter, r.page, r.idBulaPacienteProtegido) for r in got if r.letter == "a"} == {("a", 1, "i1"), ("a", 1, None), ("a", 2, "i2"), ("a", 2, None)}
    asked = open(log).read().split()
    assert sorted(asked) == ["a1", "a2", "b1", "b2", "b2", "b3", "b4", "c1", "c2", "c2", "d1"]
    names = spark.read.format("paged_listing").schema("nomeProduto string").options(letters="a", wait=0).load()
    assert sorted(r[0] for r in names.collect()) == ["a10", "a11", "a20", "a21"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        open(log, "w").close()
        spark.dataSource.register(listing.listing_source(factory, "filtered_listing", pushdown=True))
        assert spark.read.format("filtered_listing").options(letters="a,b,d", wait=0).load().filter("letter IN ('a', 'd') AND page = 1").count() == 2
        assert sorted(set(x[0] for x in open(log).read().split())) == ["a", "d"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
