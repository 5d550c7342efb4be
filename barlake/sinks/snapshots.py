"""Committed snapshots: data first, one commit record last, readers follow the latest record.

Layout below the store root:
  bars/snapshot=<id>/year=<y>/...   files that a snapshot wrote
  files/snapshot=<id>/...           the live files of the years a snapshot changed, with zone maps (operators.layers)
  tables/<name>/snapshot=<id>/...   report tables of a snapshot
  commits/<version>.json            one file per commit: a head row, a row per year, per table and per stream

A snapshot stores only what it changed; its commit record lists for every year and
every table which snapshot describes it, so one record is the whole state and the log needs no compaction. A year is
either the folder that its snapshot wrote, or the list of files that its snapshot left: files of earlier snapshots that an update
did not touch, its own, and deltas. A delta holds changed bars only; readers merge it with the files it overlaps, and
`plans.compact` folds deltas in. Old snapshots stay, which is also the archive.

A version's file is created only if it is absent. A writer pinned by `at` whose years, tables or streams were changed
since by someone else fails and has to start again from the new state; changes to others are kept, and its own commit goes on
top of them. A reader pinned by `at` sees one version throughout.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.errors import BarlakeError, CommitError
from barlake.operators.layers import FILE_SCHEMA, Split, last_layer, layered, touched
from barlake.schema import BAR_COLUMNS, BAR_SCHEMA
from barlake.sinks.bars import write_years
from barlake.sources.files import key_runs, zone_maps

COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("committed_at", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("data_snapshot", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("listed", T.BooleanType()),
        T.StructField("deltas", T.LongType()),
        T.StructField("stream", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
#: Columns of a commit row after version, snapshot and time.
_STATE = COMMIT_SCHEMA.names[3:]
SNAPSHOT_SCHEMA = T.StructType(
    [*BAR_SCHEMA.fields, T.StructField("snapshot", T.StringType()), T.StructField("year", T.IntegerType())]
)


class BarStore:
    """A bar dataset with atomic publication."""

    def __init__(self, spark: SparkSession, root: str, pinned: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.pinned = pinned

    def at(self, version: int | None = None) -> BarStore:
        """The store as of one version, by default the latest."""
        return BarStore(self.spark, self.root, self.version() if version is None else version)

    def _log(self):
        """The file system and the path class for the commit folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(f"{self.root}/commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> dict[int, bool]:
        """Versions in the log; False for one whose writer died before it wrote the record."""
        system, path = self._log()
        folder = path(f"{self.root}/commits")
        found = system.listStatus(folder) if system.exists(folder) else []
        named = ((re.fullmatch(r"(\d{12})\.json", f.getPath().getName()), f.getLen()) for f in found)
        return {int(m[1]): size > 0 for m, size in named if m}

    def commits(self) -> DataFrame:
        """All commit records."""
        if not self._versions():
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits")

    def version(self) -> int:
        """The pinned version, or the latest committed one; 0 before the first."""
        if self.pinned is not None:
            return self.pinned
        return max((v for v, done in self._versions().items() if done), default=0)

    def current(self) -> DataFrame:
        """The version's rows: its head, one per year, one per table."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits/{version:012d}.json")

    def _layout(self) -> list:
        """Rows per year; as many as the dataset has years."""
        return sorted(self.current().where("year IS NOT NULL").collect(), key=lambda r: r.year)

    def tables(self) -> dict[str, str]:
        """Which snapshot holds each report table; a fixed set of names."""
        return {r.table_name: r.data_snapshot for r in self.current().where("table_name IS NOT NULL").collect()}

    def years(self) -> list[int]:
        return [r.year for r in self._layout()]

    def applied(self, stream: str) -> int | None:
        """The last batch of a stream that is part of the version."""
        found = self.current().where(F.col("stream") == stream).select("batch_id").collect()  # one row per stream
        return max((r.batch_id for r in found), default=None)

    def files(self, years: list[int] | None = None) -> list:
        """The live files of some years, rows of FILE_SCHEMA. Years stored as a folder are listed by a scan of their keys."""
        rows = [r for r in self._layout() if years is None or r.year in years]
        found = []
        if folders := [f"{self.root}/bars/snapshot={r.data_snapshot}/year={r.year}" for r in rows if not r.listed]:
            found += self._facts(key_runs(self.spark, *folders), 0).collect()
        lists: dict[str, list[int]] = {}
        for r in rows:
            if r.listed:
                lists.setdefault(r.data_snapshot, []).append(r.year)
        for snapshot, its in lists.items():
            table = self.spark.read.schema(FILE_SCHEMA).parquet(f"{self.root}/files/snapshot={snapshot}")
            found += table.where(F.col("year").isin(its)).collect()
        return sorted(found, key=lambda f: (f.year, f.layer, f.snapshot, f.name))

    def _facts(self, runs: DataFrame, layer: int) -> DataFrame:
        """Rows of FILE_SCHEMA from the block summaries of files of this store."""
        place = {"snapshot": r"/snapshot=([^/]*)/", "year": r"/year=(-?\d+)/", "name": r"([^/]*)$"}
        cut_out = {c: F.regexp_extract("file", pattern, 1) for c, pattern in place.items()}
        return zone_maps(runs).withColumns(cut_out).withColumns({"year": F.col("year").cast("int"), "layer": F.lit(layer).cast("bigint")}).select(*FILE_SCHEMA.names)

    def bars(self, years: list[int] | None = None) -> DataFrame:
        """The current bars. Only the directories of the wanted years are opened."""
        rows = [r for r in self._layout() if years is None or r.year in years]
        plain = self.bars_of([(r.data_snapshot, r.year) for r in rows if not r.listed])
        listed = [r.year for r in rows if r.listed]
        if not listed:
            return plain
        found = self.bars_in(self.files(listed))
        return found if len(listed) == len(rows) else plain.unionByName(found)

    def bars_in(self, files: list) -> DataFrame:
        """The bars of some live files. Deltas are merged with the files they overlap, all others are read as they are."""
        split = layered(files)
        parts = []
        if split.kept:
            parts.append(self._read(split.kept).drop("snapshot"))
        if split.hit:
            layers = {f.snapshot: f.layer for f in split.hit}
            layer = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(layers.items()) for x in pair]), F.col("snapshot"))
            merged = last_layer(self._read(split.hit).select(*BAR_COLUMNS, layer.alias("_layer")), "_layer")
            parts.append(merged.withColumn("year", F.year("date")))
        if not parts:
            return self.spark.createDataFrame([], SNAPSHOT_SCHEMA).drop("snapshot")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _read(self, files: list) -> DataFrame:
        base = f"{self.root}/bars"
        paths = [f"{base}/snapshot={f.snapshot}/year={f.year}/{f.name}" for f in files]
        return self.spark.read.schema(SNAPSHOT_SCHEMA).option("basePath", base).parquet(*paths)

    def window(self, first: dt.date, last: dt.date, years: list[int]) -> Split:
        """The files of some years that may hold bars of a window, and the files that cannot."""
        return touched(self.files(years), first, last)

    def bars_of(self, parts: list[tuple[str, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SNAPSHOT_SCHEMA).drop("snapshot")
        base = f"{self.root}/bars"
        paths = [f"{base}/snapshot={s}/year={y}" for s, y in parts]
        return self.spark.read.schema(SNAPSHOT_SCHEMA).option("basePath", base).parquet(*paths).drop("snapshot")

    def stage(self, snapshot: str, bars: DataFrame) -> DataFrame:
        """Write the changed years of a snapshot; invisible until committed. Returns what was stored."""
        return self.stage_observed(snapshot, bars, None)[0]

    def stage_observed(self, snapshot: str, bars: DataFrame, rules: dict[str, Column] | None) -> tuple[DataFrame, Observation | None]:
        """The same, and how many of the written rows break each rule, counted during the write."""
        path = f"{self.root}/bars/snapshot={snapshot}"
        seen = write_years(bars, path, mode="overwrite", rules=rules)
        base = f"{self.root}/bars"
        return self.spark.read.schema(SNAPSHOT_SCHEMA).option("basePath", base).parquet(path).drop("snapshot"), seen

    def stage_files(self, snapshot: str, kept: list, runs: DataFrame | None = None, layer: int = 0) -> list:
        """Write the file list of the years a snapshot changed: the files kept and those it wrote. Returns the list.

        runs: block summaries of what the snapshot wrote (sources.files.key_runs), computed here if not given.
        """
        written = self._facts(key_runs(self.spark, f"{self.root}/bars/snapshot={snapshot}") if runs is None else runs, layer)
        every = written.unionByName(self.spark.createDataFrame([tuple(f) for f in kept], FILE_SCHEMA)) if kept else written
        # a list has a row per file of the changed years
        every.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/files/snapshot={snapshot}")
        return self.spark.read.schema(FILE_SCHEMA).parquet(f"{self.root}/files/snapshot={snapshot}").collect()

    def stage_table(self, snapshot: str, name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.root}/tables/{name}/snapshot={snapshot}")

    def table(self, name: str) -> DataFrame:
        """A report table as of the version."""
        held = self.tables()
        if name not in held:
            raise BarlakeError(f"no commit holds the table {name}")
        return self.spark.read.parquet(f"{self.root}/tables/{name}/snapshot={held[name]}")

    def save_diagnostics(self, run: str, name: str, table: DataFrame) -> str:
        """Evidence of a refused run; never part of a commit."""
        path = f"{self.root}/diagnostics/{run}/{name}"
        table.write.mode("overwrite").parquet(path)
        return path

    def _changed_since(self, version: int) -> set:
        """The years, tables and streams that commits after a version changed."""
        later = [f"{self.root}/commits/{v:012d}.json" for v, done in self._versions().items() if done and v > version]
        if not later:
            return set()
        rows = self.spark.read.schema(COMMIT_SCHEMA).json(later).where("data_snapshot = snapshot").collect()  # per commit its years and tables
        return {_place(r) for r in rows}

    def commit(
        self,
        snapshot: str,
        row_counts: dict[int, int],
        tables: tuple[str, ...] | list[str] = (),
        *,
        deltas: dict[int, int] | None = None,
        stream: tuple[str, int] | None = None,
    ) -> int:
        """Make a snapshot current: its years and tables replace, all others carry over.

        deltas: the years described by the snapshot's file list, with the number of deltas in it; without it the years are the
        snapshot's folders. stream: (name, batch) that this commit applies.
        On a pinned store commits since that changed other years, tables and streams only are kept. A change to the same ones
        is a CommitError, and so is a lost race of a store that is not pinned.
        """
        listed = deltas is not None
        new = [(y, snapshot, n, None, listed, (deltas or {}).get(y, 0), None, None) for y, n in sorted(row_counts.items())]
        new += [(None, snapshot, None, t, None, None, None, None) for t in tables]
        if stream:
            new.append((None, snapshot, None, None, None, None, *stream))
        mine = {_place(dict(zip(_STATE, row, strict=True))) for row in new}
        while True:
            version = max(self._versions(), default=0) + 1
            if self.pinned is not None and (clash := mine & self._changed_since(self.pinned)):
                raise CommitError(f"changed since version {self.pinned}: {', '.join(sorted(f'{kind} {name}' for kind, name in clash))}")
            before = BarStore(self.spark, self.root).current().collect()  # head, years, tables and streams
            kept = [tuple(r[c] for c in _STATE) for r in before if _place(r)[0] and _place(r) not in mine]
            now = dt.datetime.now(dt.UTC).isoformat()
            head = (None,) * len(_STATE)
            lines = [json.dumps(dict(zip(COMMIT_SCHEMA.names, (version, snapshot, now, *row), strict=True))) for row in [head, *kept, *new]]
            system, path = self._log()
            try:
                out = system.create(path(f"{self.root}/commits/{version:012d}.json"), False)
            except Py4JJavaError as exc:
                if self.pinned is None:
                    raise CommitError(f"version {version} was committed by another writer") from exc
                continue
            out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
            out.close()
            return version


def _place(row) -> tuple[str, str]:
    """What a commit row describes; nothing for the head."""
    for kind, column in (("year", "year"), ("table", "table_name"), ("stream", "stream")):
        if row[column] is not None:
            return kind, str(row[column])
    return "", ""
