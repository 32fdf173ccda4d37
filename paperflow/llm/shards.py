"""Immutable shards with size-tiered compaction and versioned manifests.

append() writes an arrival as small parquet shards and commits a manifest with them. compact() groups the shards that are not
yet of target size by tier (powers of FANOUT below the target); where a tier holds at least FANOUT shards, its runs of similar
size are read together in partitions of the target size, which Spark's own file packing makes without a shuffle, and written
as one shard each; what that makes is a run of a higher tier, merged again once that tier is full.

A manifest is a small JSON file named by its version. It names shard lists, of which each holds the shards of one append or
compaction: sealed lists have shards of target size, which no compaction reads again, open lists have the others. A new
version writes its own new lists alone. The manifest is written aside and renamed without overwriting, so of two writers one
fails and readers see the old or the new version, never a mix. Files that no manifest names are not read.

Nulls and odd input: rows are stored as they are, in any columns; an arrival without rows commits a version without new
shards; an arrival of another schema is an error; repeated rows and texts of any length are kept; a table without any row
reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

ARRIVALS = 16
FANOUT = 4
TARGET_BYTES = 128 << 20
FULL = 0.75  # of the target: larger shards stay as they are


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    sealed: tuple[str, ...] = ()  # shard lists
    open: tuple[str, ...] = ()
    action: str = ""


def same_columns(a: str, b: str) -> bool:
    """Two schemas (JSON) have the same names and types in the same order."""
    kinds = [[(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(x)).fields] for x in (a, b)]
    return kinds[0] == kinds[1]


class ShardTable:
    """A table of shards under root (a folder in a store that all executors share)."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout = target_bytes, fanout
        self._jvm = spark._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        fs, path = self._fs(), self._path(folder)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _put(self, path: str, found: dict) -> None:
        out = self._fs().create(self._path(path), False)
        try:
            out.write(bytearray(json.dumps(found).encode()))
        finally:
            out.close()

    def _get(self, path: str) -> dict:
        stream = self._fs().open(self._path(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """The versions that can be read, ascending."""
        return sorted(int(n[1:-5]) for s in self._list(f"{self.root}/manifest") if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest(0, "")
        found = self._get(f"{self.root}/manifest/v{version:09d}.json")
        return Manifest(found["version"], found["schema"], tuple(found["sealed"]), tuple(found["open"]), found["action"])

    def shards(self, lists: Iterable[str]) -> list[Shard]:
        return [Shard(s["path"], s["bytes"]) for x in lists for s in self._get(f"{self.root}/manifest/{x}")["shards"]]

    def _commit(self, base: Manifest, schema: str, action: str, new: list[Shard], kept: Iterable[str]) -> Manifest:
        """The version after base, with these shards and base's open lists that are kept; fails if another writer has
        committed it."""
        lists: dict[bool, list[str]] = {True: [], False: []}
        for full in (True, False):
            if part := sorted((s for s in new if (s.bytes >= FULL * self.target_bytes) == full), key=lambda s: s.path):
                lists[full].append(f"list-{uuid.uuid4().hex}.json")
                self._put(f"{self.root}/manifest/{lists[full][0]}", {"shards": [{"path": s.path, "bytes": s.bytes} for s in part]})
        out = Manifest(base.version + 1, schema, (*base.sealed, *lists[True]), (*kept, *lists[False]), action)
        aside = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        self._put(aside, {"version": out.version, "parent": base.version, "schema": schema, "action": action, "sealed": out.sealed, "open": out.open})
        conf, hadoop = self.spark._jsc.hadoopConfiguration(), self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs().getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        context.rename(self._path(aside), self._path(f"{self.root}/manifest/v{out.version:09d}.json"), options)
        return out

    def _written(self, folder: str) -> list[Shard]:
        return [Shard(f"{folder}/{n}", s.getLen()) for s in self._list(folder) if (n := s.getPath().getName()).endswith(".parquet")]

    def _add(self, schema: str, shards: list[Shard]) -> Manifest:
        base = self.manifest()
        if base.version and not same_columns(base.schema, schema):
            raise ValueError(f"the table's columns are {T.StructType.fromJson(json.loads(base.schema)).simpleString()}, the arrival's {T.StructType.fromJson(json.loads(schema)).simpleString()}")
        return self._commit(base, base.schema or schema, "append", shards, base.open)

    def append(self, df: DataFrame) -> Manifest:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self._add(df.schema.json(), self._written(folder))

    def append_each(self, df: DataFrame, arrival: str) -> Iterator[Manifest]:
        """Appends the arrivals that the column names, each a version of its own, from one pass over df. Spark sorts the rows of
        a task by arrival, so one shard is open at a time."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(folder)
        schema = df.drop(arrival).schema.json()
        found = sorted(s.getPath().getName() for s in self._list(folder) if s.isDirectory() and "=" in s.getPath().getName())
        for name in found:
            yield self._add(schema, self._written(f"{folder}/{name}"))
        if not found:
            yield self._add(schema, [])

    def compact(self) -> Manifest:
        """Merges each tier that holds at least fanout shards, the smallest first; one new version for each merge."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for s in (small := self.shards(base.open)):
                tiers.setdefault(math.floor(math.log(max(s.bytes, 1) / self.target_bytes, self.fanout)), []).append(s)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                return base
            runs = tiers[full[0]]
            session = self.spark.newSession()
            session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            session.conf.set("spark.sql.files.minPartitionNum", "1")
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self._frame(session, base.schema, runs).write.parquet(folder)
            made = self._written(folder)
            if len(made) >= len(runs):  # they are as large as the target allows
                self._fs().delete(self._path(folder), True)
                return base
            gone = {s.path for s in runs}
            self._commit(base, base.schema, f"merge of {len(runs)} shards of tier {full[0]}", [*(s for s in small if s.path not in gone), *made], ())

    def expire(self, keep: int = 1) -> int:
        """Drops all versions but the last keep ones, then the data files and lists that only those named (their readers must
        have ended)."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        lists = {v: {*m.sealed, *m.open} for v in versions if (m := self.manifest(v))}
        live = set().union(*(lists[v] for v in kept))
        dead = set().union(*(lists[v] for v in old)) - live
        gone = {s.path for s in self.shards(dead)}
        if gone:
            gone -= {s.path for s in self.shards(x for v in kept for x in self.manifest(v).open)}
        for v in old:
            self._fs().delete(self._path(f"{self.root}/manifest/v{v:09d}.json"), False)
        for path in [*gone, *(f"{self.root}/manifest/{x}" for x in dead)]:
            self._fs().delete(self._path(path), False)
        return len(gone)

    def _frame(self, session: SparkSession, schema: str, shards: list[Shard]) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return session.createDataFrame([], fields)
        return session.read.schema(fields).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m.version:
            raise ValueError("nothing has been committed")
        return self._frame(self.spark, m.schema, self.shards((*m.sealed, *m.open)))


def arrivals_compacted(docs: DataFrame, root: str, id_col: str = "doc_id", arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> tuple[ShardTable, list[tuple[int, str, int, int, int]]]:
    """Appends docs in arrivals, dealt by a hash of the id (so in whatever files docs are stored), compacts after each and
    expires what was merged. The table, and its log: version, action, open and sealed shards, bytes of each version."""
    table, log = ShardTable(docs.sparkSession, root, target_bytes), []

    def note(m: Manifest) -> None:
        small, full = table.shards(m.open), table.shards(m.sealed)
        log.append((m.version, m.action, len(small), len(full), sum(s.bytes for s in (*small, *full))))

    name = fresh(docs, "arrival")
    for appended in table.append_each(docs.withColumn(name, F.expr(f"int(pmod(xxhash64(`{id_col}`), {arrivals}))")), name):
        note(appended)
        last = table.compact()
        for v in range(appended.version + 1, last.version + 1):
            note(table.manifest(v))
        if last.version > appended.version:
            table.expire()
    return table, log
