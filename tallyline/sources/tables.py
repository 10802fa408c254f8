"""Tables of immutable Parquet folders under one pointer file per version.

A write puts new folders beside the old ones and then publishes a version: a small
JSON file that names the folders, moved into place in one step.  Readers take the
newest version, so they see all of a write or nothing of it, a failed job leaves the table
as it was, and a table can be rewritten from itself.

``KeyedTable`` holds one row per key in hash buckets.  A batch reads and rewrites the
buckets it touches and no others; the buckets double when they have grown.  A version also
remembers the last batch of every writer, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.joins import keep_first, keep_last
from tallyline.staging import stage

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published this version first; nothing was changed."""


class VersionedTable:
    """Whole-table writes: ``overwrite`` and ``append``, both published at once."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}")
        self._fs = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions --

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                schema = json.loads(self.schema.json()) if self.schema is not None else None
                return {"version": 0, "schema": schema, "buckets": 1, "folders": {}, "rows": {}, "writers": {}}
            version = known[-1]
        stream = self._fs.open(self._path(f"versions/v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Write the pointer aside and move it into place; the move fails where that version is there already."""
        aside = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final = self._path(f"versions/v{manifest['version']:010d}.json")
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if final.toUri().getScheme() else self._fs.getUri(),
                                                                    self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, final, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.root} is there already") from e
            raise
        return manifest["version"]

    def expire(self, keep: int = 2) -> None:
        """Drop all but the newest versions, and folders that none of the kept ones names; no writer may be at work."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._path(f"versions/v{version:010d}.json"), False)
        named = {f.split("/")[0] for v in known[-keep:] for some in self.manifest(v)["folders"].values() for f in some}
        data = self._path("data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)

    # -- rows --

    def _folders(self, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; without any version, no rows of the given schema."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.root} has no version yet and no schema was given")
        return self._folders([f for some in manifest["folders"].values() for f in some], T.StructType.fromJson(manifest["schema"]))

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{folder}")
        return folder

    def overwrite(self, df: DataFrame) -> int:
        """Replace all rows; with none, the schema is still there.  ``df`` may read the table itself."""
        before = self.manifest()
        folder = self._write(df)
        return self._publish({**before, "version": before["version"] + 1, "schema": json.loads(df.schema.json()), "folders": {"0": [folder]}})

    def append(self, df: DataFrame) -> int:
        before = self.manifest()
        folder = self._write(df)
        schema = before["schema"] or json.loads(df.schema.json())
        return self._publish({**before, "version": before["version"] + 1, "schema": schema,
                              "folders": {"0": [*before["folders"].get("0", []), folder]}})


class KeyedTable(VersionedTable):
    """One row per key (null is a key like others) in hash buckets of about ``rows_per_bucket`` rows.

    ``touched`` lists the folders that the last batch read.
    """

    #: Folders of a bucket that only had rows added, before they become one again.
    MOST_FOLDERS = 8

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], rows_per_bucket: int = 1 << 20):
        super().__init__(spark, root, schema)
        self.keys, self.rows_per_bucket, self.touched = list(keys), rows_per_bucket, []

    def overwrite(self, df: DataFrame) -> int:
        raise TypeError("a keyed table takes batches: upsert or add_new")

    append = overwrite

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in self.keys])

    def _done(self, manifest: dict, writer: str | None, batch_id: int | None) -> bool:
        return writer is not None and batch_id is not None and manifest["writers"].get(writer, -1) >= batch_id

    def _replace(self, manifest: dict, rows: DataFrame, kept: dict[str, list[str]], kept_rows: dict[str, int], buckets: int,
                 writer: str | None, batch_id: int | None) -> int:
        """Write rows by bucket, each bucket in one file, and publish them beside the kept folders."""
        folder = uuid.uuid4().hex
        at = f"{self.root}/data/{folder}"
        rows.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(at)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(at)
        folders, counts = {k: list(v) for k, v in kept.items()}, dict(kept_rows)
        for r in written.groupBy(BUCKET).count().collect():  # one row per bucket that was written
            name = str(r[BUCKET])
            folders.setdefault(name, []).append(f"{folder}/{BUCKET}={name}")
            counts[name] = counts.get(name, 0) + r["count"]
        writers = {**manifest["writers"], **({writer: batch_id} if writer is not None and batch_id is not None else {})}
        return self._publish({**manifest, "version": manifest["version"] + 1, "schema": json.loads(self.schema.json()),
                              "buckets": buckets, "folders": folders, "rows": counts, "writers": writers})

    def _merge(self, batch: DataFrame, writer: str | None, batch_id: int | None, replace: bool) -> int:
        manifest = self.manifest()
        if self._done(manifest, writer, batch_id):
            self.touched = []
            return manifest["version"]
        buckets, folders, counts = manifest["buckets"], manifest["folders"], manifest["rows"]
        rows = stage(batch.select(*self.schema.names), "batch")
        sizes = {str(r[0]): r[1] for r in rows.groupBy(self._bucket(buckets)).count().collect()}
        if not sizes:
            return manifest["version"]
        wanted = buckets
        while sum(counts.values()) + sum(sizes.values()) > wanted * self.rows_per_bucket:
            wanted *= 2
        if wanted > buckets:  # all buckets are dealt anew, which doubling makes rare
            touched = set(folders) | set(sizes)
        else:
            touched = set(sizes)
        self.touched = [f for b in touched for f in folders.get(b, [])]
        old = self._folders(self.touched, self.schema)
        if replace:
            merged = old.join(rows, self._same(old, rows), "left_anti").unionByName(rows)
            rewritten = touched
        else:
            known = old.select(*self.keys)
            fresh = rows.join(known, self._same(rows, known), "left_anti")
            rewritten = touched if wanted > buckets else {b for b in touched if len(folders.get(b, [])) >= self.MOST_FOLDERS}
            merged = fresh.unionByName(self._folders([f for b in rewritten for f in folders.get(b, [])], self.schema))
        kept = {b: f for b, f in folders.items() if b not in rewritten}
        return self._replace(manifest, merged, kept, {b: n for b, n in counts.items() if b in kept}, wanted, writer, batch_id)

    def upsert(self, batch: DataFrame, order: Sequence[str | Column] = (), writer: str | None = None, batch_id: int | None = None) -> int:
        """Rows of the batch replace those of the same keys; ``order`` picks the last of a key inside the batch."""
        return self._merge(keep_last(batch, self.keys, order or [F.lit(0)]), writer, batch_id, True)

    def add_new(self, batch: DataFrame, order: Sequence[str | Column] = (), writer: str | None = None, batch_id: int | None = None) -> int:
        """Rows of unseen keys, the first of each by ``order``; known keys keep their row, and only key columns are read."""
        return self._merge(keep_first(batch, self.keys, order or [F.lit(0)]), writer, batch_id, False)
