"""Persistent tables: a day-partitioned candle table and a versioned inventory, both on plain Parquet."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.operators import inventory
from candleforge.operators.reconcile import keep_last, upsert
from candleforge.operators.schemas import CANDLE_COLS, KEY, SYMBOL_MAP, as_candles, empty_candles


class _Folder:
    """A folder of the session's default or named file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, child: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.path}/{child}" if child else self.path))

    def children(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))] if self.exists() else []

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.path))

    def remove(self, child: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{child}"), True)


class CandleStore:
    """Candles keyed by (symbol, timestamp), partitioned by UTC day.

    Every day's rows lie in a folder of the commit that wrote them, and a manifest names each day's folder. A commit
    writes the touched days anew and then publishes the next manifest, which appears at once or not at all: an
    executor, a driver or the write itself lost at any point leaves the old rows readable, and committing again
    finishes the job. Of two commits at once the later one to publish fails and may be repeated.
    """

    _MANIFEST = "day date, commit string"
    _VERSION = re.compile(r"v(\d{8})$")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self._root = _Folder(spark, path)
        self._manifests = _Folder(spark, f"{self._root.path}/manifest")
        self.table = f"{self._root.path}/market_data"

    def create(self) -> None:
        self._root.make()

    def _versions(self) -> list[int]:
        found = [int(m[1]) for c in self._manifests.children() if (m := self._VERSION.match(c)) and self._manifests.exists(f"{c}/_SUCCESS")]
        return sorted(found)

    def _days(self, version: int) -> dict[dt.date, str]:
        """The commit of each day: one entry for each day of the table."""
        if not version:
            return {}
        return {r.day: r.commit for r in self.spark.read.schema(self._MANIFEST).parquet(f"{self._manifests.path}/v{version:08d}").collect()}

    def _read(self, days: dict[dt.date, str]) -> DataFrame:
        schema = empty_candles(self.spark).schema.add("day", "date")
        if not days:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.table}/day={day}/commit={commit}" for day, commit in sorted(days.items())]
        return self.spark.read.schema(schema.add("commit", "string")).option("basePath", self.table).parquet(*folders).drop("commit")

    def read(self) -> DataFrame:
        """All candles with their day; an absent table is empty."""
        return self._read(self._days(max(self._versions(), default=0)))

    def landed(self, rows: DataFrame, name: str) -> DataFrame:
        """rows written beside the table and read again; the last landing of a name stays, for replays."""
        path = f"{self._root.path}/_landed/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, incoming: DataFrame, order: Sequence[Column] = ()) -> int:
        """Upsert whole rows; of repeated keys within incoming the last in `order` stays, by default the
        greatest row. Returns the number of days rewritten, 0 for an empty batch."""
        fresh = as_candles(incoming)
        extra = order or [F.col(c) for c in CANDLE_COLS if c not in KEY]
        fresh = keep_last(fresh, KEY, extra).withColumn("day", F.to_date("timestamp"))
        name = uuid.uuid4().hex
        staged = f"{self._root.path}/_stage_{name}"
        # the batch is fixed first: its lineage may read a source that answers differently the next time
        fresh.write.partitionBy("day").parquet(staged)
        try:
            batch = self.spark.read.schema(empty_candles(self.spark).schema.add("day", "date")).parquet(staged)
            days = sorted(r.day for r in batch.select("day").distinct().collect())  # partitions to rewrite, not rows
            if not days:
                return 0
            version = max(self._versions(), default=0)
            held = self._days(version)
            merged = upsert(self._read({d: c for d, c in held.items() if d in days}), batch, KEY, extra)
            merged.withColumn("commit", F.lit(name)).repartition("day").sortWithinPartitions("day", "symbol", "timestamp").write.mode("append").partitionBy("day", "commit").parquet(self.table)
            self._publish(version + 1, held | dict.fromkeys(days, name))
            self._tidy(version, {d: c for d, c in held.items() if d in days})
            return len(days)
        finally:
            self._root.remove(f"_stage_{name}")

    def _publish(self, version: int, days: dict[dt.date, str]) -> None:
        rows = self.spark.createDataFrame(sorted(days.items()), self._MANIFEST)
        rows.coalesce(1).write.mode("error").parquet(f"{self._manifests.path}/v{version:08d}")

    def _tidy(self, version: int, replaced: dict[dt.date, str]) -> None:
        """Folders and manifests that the last version no longer needs; readers of the version before it keep theirs until
        the next commit of the same days."""
        old = self._days(version - 1) if version - 1 in self._versions() else {}
        for day in replaced:
            if day in old and old[day] != replaced[day]:
                self._root.remove(f"market_data/day={day}/commit={old[day]}")
        for v in self._versions():
            if v < version - 1:
                self._manifests.remove(f"v{v:08d}")


class InventoryStore:
    """The symbol inventory as numbered versions; the newest complete one is current, so edits are atomic."""

    _VERSION = re.compile(r"v(\d{8})$")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self._root = _Folder(spark, path)

    def _current(self) -> int:
        found = [int(m[1]) for c in self._root.children() if (m := self._VERSION.match(c)) and self._root.exists(f"{c}/_SUCCESS")]
        return max(found, default=0)

    def _put(self, df: DataFrame) -> None:
        df.select(*SYMBOL_MAP.names).coalesce(1).write.mode("overwrite").parquet(f"{self._root.path}/v{self._current() + 1:08d}")

    def create(self) -> None:
        """Make the inventory if it is missing, and seed it if it is empty."""
        if self._current() == 0 or self.read().isEmpty():
            self._put(inventory.seed(self.spark))

    def read(self) -> DataFrame:
        n = self._current()
        if n == 0:
            return self.spark.createDataFrame([], SYMBOL_MAP)
        return self.spark.read.schema(SYMBOL_MAP).parquet(f"{self._root.path}/v{n:08d}")

    def listing(self) -> DataFrame:
        return self.read().orderBy("user_ticker")

    def upsert(self, ticker: str, epic: str = "", choice: str = inventory.HYBRID) -> None:
        self._put(inventory.upsert_entries(self.read(), inventory.entry_row(self.spark, ticker, epic, choice)))

    def delete(self, ticker: str) -> None:
        self._put(inventory.delete_entry(self.read(), ticker))

    def rename(self, old: str, ticker: str, epic: str = "", choice: str = inventory.HYBRID) -> None:
        self._put(inventory.rename_entry(self.read(), old, inventory.entry_row(self.spark, ticker, epic, choice)))
