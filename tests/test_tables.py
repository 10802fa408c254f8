"""Versioned and keyed tables: failed writers, replayed batches, and the work of a batch."""

import pytest
from pyspark.sql import functions as F

from tallyline.sources import ingest
from tallyline.sources.tables import Conflict, KeyedTable, VersionedTable
from tallyline.staging import new_path

SCHEMA = "id bigint, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_failing_writer_leaves_the_table(spark):
    path = new_path(spark, "versioned")
    table = VersionedTable(spark, path, frame(spark, []).schema)
    assert table.read().count() == 0
    table.overwrite(frame(spark, [(1, "a"), (2, "b")]))
    broken = frame(spark, [(k, "bad" if k == 70 else "x") for k in range(100)]).repartition(5)
    broken = broken.withColumn("v", F.when(F.col("v") == "bad", F.raise_error(F.lit("a writer that breaks off"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        table.overwrite(broken)
    with pytest.raises(Exception):
        table.append(broken)
    assert rows_of(table.read()) == [(1, "a"), (2, "b")] and len(table.versions()) == 1
    # and the plain sink keeps its old folder as well
    ingest.overwrite(frame(spark, [(1, "a")]), f"{path}/plain")
    with pytest.raises(Exception):
        ingest.overwrite(broken, f"{path}/plain")
    assert rows_of(spark.read.parquet(f"{path}/plain")) == [(1, "a")]


def test_a_table_is_rewritten_from_itself(spark):
    table = VersionedTable(spark, new_path(spark, "versioned"))
    with pytest.raises(ValueError):
        table.read()
    table.overwrite(frame(spark, [(1, "a"), (2, "b")]))
    reader = table.read()
    table.overwrite(table.read().withColumn("v", F.upper("v")))
    table.append(table.read().where("id = 2"))
    assert rows_of(reader) == [(1, "a"), (2, "b")]  # a reader keeps the version it began with
    assert rows_of(table.read()) == [(1, "A"), (2, "B"), (2, "B")] and rows_of(table.read(1)) == [(1, "a"), (2, "b")]
    table.expire(keep=1)
    assert table.versions() == [3] and rows_of(table.read()) == [(1, "A"), (2, "B"), (2, "B")]
    table.overwrite(table.read().where("false"))
    assert table.read().schema.names == ["id", "v"] and table.read().count() == 0


def test_two_writers_of_one_version(spark):
    table = VersionedTable(spark, new_path(spark, "versioned"))
    table.overwrite(frame(spark, [(1, "a")]))
    manifest = table.manifest()
    table.overwrite(frame(spark, [(2, "b")]))
    with pytest.raises(Conflict):
        table._publish({**manifest, "version": manifest["version"] + 1})
    assert rows_of(table.read()) == [(2, "b")]


def test_upsert_against_a_dict_with_null_keys_and_growing_buckets(spark):
    table = KeyedTable(spark, new_path(spark, "keyed"), frame(spark, []).schema, ["id"], rows_per_bucket=20)
    want = {}
    for batch in range(5):
        rows = [((k * 7 + batch) % 60 if k % 11 else None, f"{batch}-{k:02d}") for k in range(40)]
        table.upsert(frame(spark, rows).repartition(3), ["v"], "w", batch)
        for key, v in sorted(rows, key=lambda r: r[1]):
            want[key] = v
        assert rows_of(table.read()) == sorted(want.items(), key=repr)
    manifest = table.manifest()
    assert manifest["buckets"] >= 4 and sum(manifest["rows"].values()) == len(want)


def test_a_batch_reads_the_buckets_it_touches(spark):
    table = KeyedTable(spark, new_path(spark, "keyed"), frame(spark, []).schema, ["id"], rows_per_bucket=50)
    read = []
    for size in (1000, 4000):  # the table grows, the batch does not
        table.upsert(frame(spark, [(k, "old") for k in range(size)]))
        before = table.manifest()
        table.upsert(frame(spark, [(3, "new"), (5, "new"), (10 ** 9, "new")]))
        after = table.manifest()
        changed = [b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)]
        assert len(changed) <= 3 and sum(after["rows"][b] for b in changed) < 400
        read.append(len(table.touched))
    assert max(read) <= 3
    assert table.read().where("v = 'new'").count() == 3 and table.read().count() == 4001


def test_a_replayed_batch_changes_nothing(spark):
    table = KeyedTable(spark, new_path(spark, "keyed"), frame(spark, []).schema, ["id"])
    table.add_new(frame(spark, [(1, "b"), (1, "a"), (2, "c")]), ["v"], "stream", 0)
    versions = table.versions()
    table.add_new(frame(spark, [(1, "z"), (3, "z")]), ["v"], "stream", 0)  # the same batch again, whatever it holds
    assert table.versions() == versions and rows_of(table.read()) == [(1, "a"), (2, "c")]
    table.add_new(frame(spark, [(1, "z"), (3, "z"), (None, "n")]), ["v"], "stream", 1)
    table.add_new(frame(spark, [(None, "m")]), ["v"], "stream", 2)
    assert rows_of(table.read()) == sorted([(1, "a"), (2, "c"), (3, "z"), (None, "n")], key=repr)
    table.add_new(frame(spark, []), ["v"], "stream", 3)
    with pytest.raises(TypeError):
        table.append(frame(spark, []))


def test_added_folders_become_one_again(spark):
    table = KeyedTable(spark, new_path(spark, "keyed"), frame(spark, []).schema, ["id"])
    for batch in range(12):
        table.add_new(frame(spark, [(batch, "x"), (batch // 2, "y")]), ["v"])
        assert len(table.touched) <= KeyedTable.MOST_FOLDERS
    assert rows_of(table.read()) == sorted([(k, "x") for k in range(12)], key=repr)
