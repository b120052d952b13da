"""Immutable sorted runs under a manifest: what the incremental indexes are kept in."""

from __future__ import annotations

import base64
import json
import os
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewrack.runtime import exists, get, put, remove, together


class RunStore:
    """Tables of several kinds, each a list of runs. A run is written once, bucketed and sorted by its first column, and never changed.

    ``path`` must be shared by all executors. The manifest names the runs that are whole and is replaced as one file, so what a broken attempt left behind is
    never read. ``settings`` are kept in it and must be the same when the store is opened again; ``notes`` are its owner's. Catalogue entries are the
    session's own, made when a run is read; :meth:`close` drops them.

    What :meth:`add` is given is no run yet: it is kept in memory and in a small log file, which the manifest names, until there are ``FRESH_ROWS`` rows or
    ``FRESH_LOGS`` files; then it becomes one run of each kind. So a small batch starts no job for what it adds.
    """

    FANOUT, FRESH_ROWS, FRESH_LOGS = 4, 400_000, 64

    def __init__(self, spark: SparkSession, path: str, kinds: dict[str, str], **settings) -> None:
        self.spark, self.path, self.kinds, self.settings = spark, path, kinds, settings
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: dict[str, list] = {kind: [] for kind in kinds}  # [level, folder] of each run
        self.notes: dict = {}
        self.count = 0
        self.tables: dict[str, str] = {}
        self.logs: list[str] = []
        self.schemas = {kind: to_arrow_schema(_parse_datatype_string(columns)) for kind, columns in kinds.items()}
        self.fresh: dict[str, pa.Table] = {kind: schema.empty_table() for kind, schema in self.schemas.items()}
        if exists(spark, f"{path}/manifest"):
            told = json.loads(get(spark, f"{path}/manifest"))
            if told["settings"] != settings:
                raise ValueError(f"the index at {path} was made with {told['settings']}")
            self.buckets, self.runs, self.notes, self.count = told["buckets"], told["runs"], told["notes"], told["count"]
            for name in told.get("logs", []):
                self._keep(name, {kind: pa.ipc.open_stream(base64.b64decode(x)).read_all() for kind, x in json.loads(get(spark, f"{path}/{name}")).items()})

    def commit(self, **added: list | None) -> None:
        """Names new runs, by kind, in the manifest."""
        for kind, run in added.items():
            if run is not None:
                self.runs[kind].append(run)
        put(self.spark, f"{self.path}/manifest", json.dumps({"settings": self.settings, "buckets": self.buckets, "runs": self.runs, "notes": self.notes, "count": self.count, "logs": self.logs}))

    def _keep(self, name: str, tables: dict[str, pa.Table]) -> None:
        self.logs.append(name)
        for kind, table in tables.items():
            self.fresh[kind] = pa.concat_tables([self.fresh[kind], table]).combine_chunks()

    def add(self, **rows: list[tuple]) -> None:
        """Rows of several kinds, few enough for the driver, in one log file."""
        tables, told, name = {}, {}, f"log-{self.count:06d}-{os.urandom(4).hex()}"
        self.count += 1
        for kind, own in rows.items():
            if own:
                schema = self.schemas[kind]
                tables[kind] = pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*own), schema)], schema=schema)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as out:
                    out.write_table(tables[kind])
                told[kind] = base64.b64encode(sink.getvalue()).decode()
        if tables:
            put(self.spark, f"{self.path}/{name}", json.dumps(told))
            self._keep(name, tables)
            self.commit()
        if sum(t.num_rows for t in self.fresh.values()) > self.FRESH_ROWS or len(self.logs) > self.FRESH_LOGS:
            self.flush()

    def flush(self) -> None:
        """Makes what :meth:`add` was given a run of each kind."""
        logs, self.logs = self.logs, []
        runs = self.write_all(few=True, **{kind: self.spark.createDataFrame(t) for kind, t in self.fresh.items() if t.num_rows})
        self.fresh = {kind: t.schema.empty_table() for kind, t in self.fresh.items()}
        self.commit(**runs)
        for name in logs:
            remove(self.spark, f"{self.path}/{name}")
        self.compact()

    def within(self, kind: str, keys: pa.Array) -> list[dict]:
        """What of :meth:`add` isn't in a run yet, under the given keys."""
        return self.fresh[kind].filter(pc.is_in(self.fresh[kind].column(0), value_set=keys)).to_pylist()

    def write(self, kind: str, df: DataFrame, level: int = 0, few: bool = False) -> list:
        """A run as files bucketed and sorted by its first column, so merging and grouping by it need no exchange; to be named by :meth:`commit`. ``few`` rows are written by one task."""
        key, name, folder = df.columns[0], f"tidewrack_{os.urandom(8).hex()}", f"{kind}-{self.count:06d}-{os.urandom(4).hex()}"
        self.count += 1
        (df.coalesce(1) if few else df.repartition(self.buckets, key)).write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.tables[folder] = name
        return [level, folder]

    def write_all(self, level: int = 0, few: bool = False, **frames: DataFrame) -> dict[str, list]:
        """Runs of several kinds, written at the same time."""
        return dict(zip(frames, together(*(partial(self.write, kind, df, level, few) for kind, df in frames.items()))))

    def read(self, kind: str, run: list) -> DataFrame:
        folder = run[1]
        if folder not in self.tables:
            name, key = f"tidewrack_{os.urandom(8).hex()}", self.kinds[kind].split()[0]
            self.spark.sql(f"CREATE TABLE {name} ({self.kinds[kind]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
            self.tables[folder] = name
        return self.spark.table(self.tables[folder])

    def written(self, kind: str) -> DataFrame | None:
        """All runs of a kind together; ``None`` before the first."""
        every = [self.read(kind, run) for run in self.runs[kind]]
        return reduce(DataFrame.unionByName, every) if every else None

    def all(self, kind: str) -> DataFrame | None:
        """All runs of a kind and what isn't in a run yet; ``None`` where there is neither."""
        every, fresh = self.written(kind), self.fresh[kind]
        if not fresh.num_rows:
            return every
        fresh = self.spark.createDataFrame(fresh)
        return fresh if every is None else every.unionByName(fresh)

    def compact(self) -> None:
        """Merges the runs of a level into one of the next level once there are ``FANOUT`` of them; the merged ones go once the manifest names the new one."""
        while True:
            due: dict[str, list] = {}  # of each kind the runs of the lowest level that is full; kinds are merged at the same time
            for kind in self.kinds:
                for level in sorted({at for at, _ in self.runs[kind]}):
                    own = [run for run in self.runs[kind] if run[0] == level]
                    if len(own) >= self.FANOUT:
                        due[kind] = own
                        break
            if not due:
                return
            frames = {kind: reduce(DataFrame.unionByName, [self.read(kind, run) for run in own]) for kind, own in due.items()}
            merged = dict(zip(due, together(*(partial(self.write, kind, frames[kind], own[0][0] + 1) for kind, own in due.items()))))
            for kind, own in due.items():
                self.runs[kind] = [run for run in self.runs[kind] if run not in own]
            self.commit(**merged)
            for _, folder in (run for own in due.values() for run in own):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(folder)}")
                remove(self.spark, f"{self.path}/{folder}")

    def close(self, delete: bool = False) -> None:
        """Drops the session's catalogue entries and, with ``delete``, the index itself."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        if delete:
            remove(self.spark, self.path)
