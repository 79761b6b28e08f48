"""Sinks (SNK-*): keyed upsert, partition replace, insert-ignore, append.

A table is a folder of Parquet folders and a chain of small manifests.  A
manifest names, per date, the folders that hold the table's rows.  A commit
writes new folders beside the old ones and then publishes the next manifest
by a rename that fails when its number is taken, through Hadoop's file system:
a crash before the rename leaves the old table, readers see either the old or
the new one, and of two writers at once the later one starts over.  Only the
dates that a commit touches are read.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

ATTEMPTS = 5


class DatedTable:
    """Rows by date (``date_col`` stays a column of the files)."""

    def __init__(self, spark: SparkSession, path: str, date_col: str = "run_date"):
        self.spark, self.path, self.date_col = spark, path.rstrip("/"), date_col
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, date -> folders) of the last commit; number 0: no table."""
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return 0, {}
        numbers = [int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._at(f"_manifests/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, schema, dates: list[str] | None = None, state: dict[str, list[str]] | None = None) -> DataFrame:
        """Rows of ``dates`` (None: all); other dates' files are not opened."""
        state = self.manifest()[1] if state is None else state
        folders = [f"{self.path}/{f}" for d, fs in state.items() if dates is None or d in dates for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _stage(self, rows: DataFrame, dates: list[str]) -> dict[str, list[str]]:
        """Write ``rows`` into a folder per date; dates without rows get none."""
        name = f"data/{uuid.uuid4().hex}"
        day = F.coalesce(F.col(self.date_col).cast("string"), F.lit("null"))
        rows.withColumn("_day", day).write.partitionBy("_day").parquet(f"{self.path}/{name}")
        return {d: [f"{name}/_day={d}"] if self._fs.exists(self._at(f"{name}/_day={d}")) else [] for d in dates}

    def _publish(self, number: int, state: dict[str, list[str]]) -> bool:
        """Make ``state`` manifest ``number``; False when another writer has."""
        new = self._at(f"_manifests/{number:012d}.json")
        self._fs.mkdirs(self._at("_manifests"))
        draft = self._at(f"_manifests/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({d: f for d, f in state.items() if f}).encode()))
        out.close()
        if self._fs.exists(new):
            self._fs.delete(draft, False)
            return False
        return self._fs.rename(draft, new)

    def commit(self, dates: list[str], make: Callable[[dict[str, list[str]]], DataFrame], add: bool = False) -> None:
        """Set the rows of ``dates`` to ``make(state)``, or add these rows."""
        for _ in range(ATTEMPTS):
            number, state = self.manifest()
            fresh = self._stage(make(state), dates)
            if self._publish(number + 1, {**state, **{d: (state.get(d, []) if add else []) + f for d, f in fresh.items()}}):
                return
        raise RuntimeError(f"{self.path}: {ATTEMPTS} commits in a row met another writer's")


def _dates(rows: DataFrame, col: str) -> list[str]:
    """The distinct dates (one row per run date reaches the driver)."""
    return [r[0] if r[0] is not None else "null" for r in rows.select(F.col(col).cast("string")).distinct().collect()]


def upsert_by_key(new: DataFrame, path: str, key: list[str], date_col: str = "run_date") -> None:
    """SNK-1: insert or overwrite by natural key, which holds the date; re-runs
    give the same table.  Rows of a touched date whose key is not in ``new`` stay."""
    table, dates = DatedTable(new.sparkSession, path, date_col), _dates(new, date_col)

    def rows(state):
        kept = table.read(new.schema, dates, state).join(new.select(*key), key, "left_anti")
        return new.unionByName(kept.select(*new.columns))
    table.commit(dates, rows)


def replace_partition(new: DataFrame, path: str, targets: DataFrame, partition_cols: tuple[str, str] = ("run_date", "depot_id")) -> None:
    """SNK-2: the rows of every target (run_date, depot) go and the fresh ones
    come, also when a target's fresh set is empty."""
    cols, (date_col, _) = list(partition_cols), partition_cols
    table, dates = DatedTable(new.sparkSession, path, date_col), _dates(targets, date_col)

    def rows(state):
        kept = table.read(new.schema, dates, state).join(targets.select(*cols).distinct(), cols, "left_anti")
        return new.join(targets.select(*cols).distinct(), cols, "left_semi").select(*new.columns).unionByName(kept.select(*new.columns))
    table.commit(dates, rows)


def insert_ignore(new: DataFrame, path: str, key: list[str], order: list[str], date_col: str = "run_date") -> None:
    """SNK-3: of the new rows of a key the first by ``order`` is added, and none
    whose key the table has, the same day's included: what was decided about
    an action since survives a second run."""
    table, dates = DatedTable(new.sparkSession, path, date_col), _dates(new, date_col)

    def rows(state):
        have = table.read(new.schema, dates, state).select(*key)
        first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
        return first.join(have, [first[k].eqNullSafe(have[k]) for k in key], "left_anti")
    table.commit(dates, rows, add=True)


def append_log(rows: DataFrame, path: str, date_col: str = "run_date") -> None:
    """SNK-4: append-only log (no updates or deletes)."""
    DatedTable(rows.sparkSession, path, date_col).commit(_dates(rows, date_col), lambda state: rows, add=True)
