"""Tables that are saved by key: a save adds rows and replaces those of its keys, and leaves all others as they are.

A version of a table is a list of immutable Parquet files, each with the range of its keys and a Bloom filter of them. A save finds the
files that can hold one of its keys, rewrites these alone, and commits the next version; a file that none of the keys is in is taken
over as it stands. The list is a table too, read and joined by Spark. Versions are committed by making a file that must not exist
yet; of two writers one is first, and the other one starts again from the new version, so neither loses rows.

Nulls and odd input: a null in a key is a value of its own; a repeated key within one save needs order_by (the greatest wins, then the
greatest row by hash), else it is an error; an empty save commits nothing; rows have the columns of the first save, others are an
error."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, written

FILES = "file string, n long, low string, high string, bloom binary"
FILE_ROWS = 200_000
SLOT_KEYS, MOST_SLOTS = 50_000, 1_000
BITS_A_KEY, HASHES = 10, 7
TRIES = 50


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each 64-bit hash, by double hashing."""
    u = h.astype(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(h: np.ndarray) -> bytes:
    size = max(64, -(-len(h) * BITS_A_KEY // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_places(h, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_places(h, len(bits))].all(axis=1)


class KeyedTable:
    """The table at path with these key columns. Nothing is read or written before a method is called."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], file_rows: int = FILE_ROWS, slot_keys: int = SLOT_KEYS):
        self.spark, self.path, self.key, self.file_rows, self.slot_keys = spark, path.rstrip("/"), list(key), file_rows, slot_keys

    def key_text(self) -> Column:
        return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in self.key])

    # --- versions

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def commit_of(self, version: int | None = None) -> dict | None:
        """What a version's commit says: list (its table of files), schema, and counts of the save; None before the first save."""
        known = self.versions()
        if not known:
            return None
        fs, at = self._fs(f"{self.path}/versions/{known[-1] if version is None else version:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, info: dict) -> bool:
        """Makes the version's file whole and at once, unless it exists: false then. A link on local disks, elsewhere a rename that doesn't
        overwrite (atomic in HDFS; object stores need one that offers it)."""
        fs, to = self._fs(f"{self.path}/versions/{version:08d}.json")
        _, draft = self._fs(f"{self.path}/versions/{uuid.uuid4().hex}.draft")
        fs.mkdirs(to.getParent())
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(info).encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), to.toUri().getPath())
            else:
                options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, to, options)
            return True
        except Exception:
            if not fs.exists(to):
                raise
            return False
        finally:
            fs.delete(draft, False)

    # --- files

    def _files(self, commit: dict | None) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.path}/{commit['list']}") if commit else self.spark.createDataFrame([], FILES)

    def _of_files(self, files: DataFrame, schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{r.file}" for r in files.select("file").toLocalIterator()]  # names alone, as Spark's own listing of a table
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _described(self, folder: str) -> DataFrame:
        """FILES rows of the data files of a folder."""

        def run(rows: pa.Table) -> pa.Table:
            h = rows.column("h").to_numpy()
            return pa.table({"file": rows.column("file")[:1], "bloom": pa.array([bloom(h)], pa.binary())})

        rows = self.spark.read.parquet(f"{self.path}/{folder}").select(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file"), self.key_text().alias("k")).withColumn("h", F.xxhash64("k"))
        filters = rows.select("file", "h").groupBy("file").applyInArrow(run, "file string, bloom binary")
        return rows.groupBy("file").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).join(filters, "file").select("file", "n", "low", "high", "bloom")

    def _touched(self, files: DataFrame, keys: DataFrame) -> DataFrame:
        """file of the files that can hold one of the keys (k). Keys are ranged into slots; a file meets the slots that its range overlaps,
        and the keys in its range are looked up in its filter, all at once."""
        distinct = keys.select("k").distinct()
        slots = min(MOST_SLOTS, distinct.count() // self.slot_keys + 1)
        ranged = written(distinct.repartitionByRange(slots, "k").select("k", F.xxhash64("k").alias("h"), F.spark_partition_id().alias("slot")), "keys")
        spans = F.broadcast(ranged.groupBy(F.col("slot").alias("at")).agg(F.min("k").alias("first"), F.max("k").alias("last")))  # at most MOST_SLOTS rows
        near = files.join(spans, (F.col("low") <= F.col("last")) & (F.col("high") >= F.col("first"))).select("at", "file", "low", "high", "bloom")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            k, h = b.column("k").to_numpy(zero_copy_only=False).astype(object), b.column("h").to_numpy()
            order = np.array(sorted(range(len(k)), key=lambda i: k[i].encode()), np.int64)
            k, h = np.array([x.encode() for x in k[order]], object), h[order]
            found = []
            for file, low, high, filter_ in zip(*(a.column(c).to_pylist() for c in ("file", "low", "high", "bloom")), strict=True):
                lo, hi = np.searchsorted(k, low.encode()), np.searchsorted(k, high.encode(), "right")
                if hi > lo and may_hold(filter_, h[lo:hi]).any():
                    found.append(file)
            return pa.table({"file": pa.array(found, pa.string())})

        out = written(near.groupBy("at").cogroup(ranged.groupBy("slot")).applyInArrow(run, "file string").distinct(), "touched")
        dropped(ranged)
        return out

    # --- use

    def read(self, version: int | None = None) -> DataFrame:
        commit = self.commit_of(version)
        if commit is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._of_files(self._files(commit), T.StructType.fromJson(commit["schema"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of these keys (the key columns), from the files alone that can hold one."""
        commit = self.commit_of()
        if commit is None:
            raise FileNotFoundError(f"no version of {self.path}")
        touched = self._touched(self._files(commit), keys.select(self.key_text().alias("k")))
        rows = self._of_files(touched, T.StructType.fromJson(commit["schema"])).withColumn("_k", self.key_text())
        return rows.join(keys.select(self.key_text().alias("_k")).distinct(), "_k", "left_semi").drop("_k")

    def save(self, rows: DataFrame, order_by: str | None = None, delete: bool = False) -> dict:
        """Adds rows, replaces those of the same keys (or only deletes them); returns the commit. Starts again when another writer was first."""
        new = rows.withColumn("_k", self.key_text())
        if order_by is None:
            new = written(new, "save")
            twice = [r["_k"] for r in new.groupBy("_k").count().where("count > 1").limit(3).collect()]
            if twice:
                dropped(new)
                raise ValueError(f"repeated keys in one save: {twice}")
        else:
            whole = F.struct(*rows.columns)
            new = written(new.groupBy("_k").agg(F.max_by(whole, F.struct(order_by, F.xxhash64(*rows.columns))).alias("r")).select("_k", "r.*"), "save")
        try:
            if not new.limit(1).count():
                return self.commit_of() or {}
            for _ in range(TRIES):
                commit = self._saved(new, rows.schema, delete, self.commit_of())
                if commit is not None:
                    return commit
            raise RuntimeError(f"{self.path}: other writers were first {TRIES} times")
        finally:
            dropped(new)

    def transact(self, make: Callable[[DataFrame | None], DataFrame], number: int | None = None) -> dict:
        """Saves the rows that make() gives for the table as it stands (None before the first save), and no other way: when another writer
        was first, make() is asked again for the table that this one left. Without rows nothing is committed. number: of this change in
        an ascending sequence of one writer; a change that the table has already isn't made again."""
        for _ in range(TRIES):
            base = self.commit_of()
            if number is not None and base and base.get("number") is not None and base["number"] >= number:
                return base
            rows = make(self.read(base["version"]) if base else None)
            new = written(rows.withColumn("_k", self.key_text()), "save")
            try:
                if not new.limit(1).count():
                    return base or {}
                commit = self._saved(new, rows.schema, False, base, number)
            finally:
                dropped(new)
            if commit is not None:
                return commit
        raise RuntimeError(f"{self.path}: other writers were first {TRIES} times")

    def _saved(self, new: DataFrame, schema: T.StructType, delete: bool, base: dict | None, number: int | None = None) -> dict | None:
        """The commit after base; None if there is one already."""
        version = (base["version"] if base else 0) + 1
        if base:
            schema = T.StructType.fromJson(base["schema"])
            if {(f.name, f.dataType.simpleString()) for f in schema} != {(f.name, f.dataType.simpleString()) for f in new.drop("_k").schema}:
                raise ValueError(f"columns of the save differ from the table's: {schema.simpleString()}")
        files = self._files(base)
        touched = self._touched(files, new.select(F.col("_k").alias("k")))
        old = self._of_files(touched, schema).withColumn("_k", self.key_text())
        kept = old.join(new.select("_k"), "_k", "left_anti")
        whole = kept.select("_k", *schema.names) if delete else kept.select("_k", *schema.names).unionByName(new.select("_k", *schema.names))
        n_old, n_touched, n_files = (touched.join(files, "file").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], touched.count(), files.count())
        folder = f"data/{uuid.uuid4().hex}"
        parts = max(1, -(-(n_old + (0 if delete else new.count())) // self.file_rows))
        whole.repartitionByRange(parts, "_k").sortWithinPartitions("_k").drop("_k").write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.path}/{folder}")
        added = written(self._described(folder), "described")
        n_rows, n_new = added.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        listed = f"lists/{uuid.uuid4().hex}"
        files.join(touched, "file", "left_anti").unionByName(added).coalesce(max(1, (n_files + n_new) // 5000)).write.parquet(f"{self.path}/{listed}")
        dropped(touched, added)
        number = number if number is not None else base.get("number") if base else None
        info = {"version": version, "number": number, "list": listed, "schema": schema.jsonValue(), "files_before": n_files, "files_rewritten": n_touched, "files_written": n_new, "rows_read": n_old, "rows_written": n_rows}
        if self._commit(version, info):
            return info
        for left in (folder, listed):  # nobody knows of them
            fs, at = self._fs(f"{self.path}/{left}")
            fs.delete(at, True)
        return None
