"""A copy-on-write table: rows in buckets by id, of which a write replaces only those that it touches.

A version is a manifest that names the files of every bucket. A write puts new files beside the old ones and then
publishes the next manifest, so readers see the table before or after it, never in between: a write that is cut short
leaves files that no manifest names. Of two writers that start from one version the second one fails and can run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.sources import manifest
from driftwatch.sources.tables import latest_values, one_per_key

_BUCKET = "_bucket"


class CopyOnWriteTable:
    """Rows with one id each. Null ids are refused, repeated ids in one request count as one (see the methods)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64, order: list[Column] | None = None) -> CopyOnWriteTable:
        """A table that holds ``rows``; of rows with one id the first in ``order`` stays.

        ``buckets`` sets how much a small write copies: the size of a bucket, which should fit a few task partitions.
        """
        if buckets < 1:
            raise ValueError("buckets must be positive")
        table = cls(rows.sparkSession, path)
        state = {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "files": {}}
        table._publish(state, table._write(one_per_key(rows, key, order or []).select(rows.columns), state), replaced=[])
        return table

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in manifest.names(self.spark, f"{self.path}/_versions")]

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default."""
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return manifest.load(self.spark, f"{self.path}/_versions/{version:012d}.json")

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        return self._rows(state, state["files"])

    def append(self, rows: DataFrame) -> int:
        """Add rows whose ids the table does not hold; others are left as they are. Adds files, copies none."""
        state = self.state()
        known = self._touched(state, rows)
        new = one_per_key(self._typed(state, rows), state["key"], []).join(known.select(state["key"]), state["key"], "left_anti")
        return self._publish(state, self._write(new.select(self._schema(state).names), state), replaced=[])

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Replace or add rows by id; of several rows with one id the first in ``order`` counts."""
        state = self.state()
        one = one_per_key(self._typed(state, rows), state["key"], order or [])
        kept = self._touched(state, one).join(one.select(state["key"]), state["key"], "left_anti")
        return self._replace(state, one, kept.unionByName(one))

    def patch(self, requests: DataFrame, fields: list[str], order: list[Column] | None = None, stamp: tuple[str, Column] | None = None) -> int:
        """Set ``fields`` where the request of an id has a value; unknown ids are left out.

        Several requests of one id are applied one after the other: each field takes the value of the first request in
        ``order`` (newest first) that has one. ``stamp`` sets a column of the rows that have a request.
        """
        state = self.state()
        key = state["key"]
        one = latest_values(requests, key, fields, order or []).select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
        joined = self._touched(state, one).join(one, key, "left")
        updates = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
        if stamp is not None:
            updates[stamp[0]] = F.when(F.col("_hit"), stamp[1]).otherwise(F.col(stamp[0]))
        return self._replace(state, one, joined.withColumns(updates).select(self._schema(state).names))

    def delete(self, ids: DataFrame) -> int:
        """Drop the rows whose id stands in ``ids``' key column."""
        state = self.state()
        gone = ids.select(state["key"]).distinct()
        return self._replace(state, gone, self._touched(state, gone).join(gone, state["key"], "left_anti"))

    # --- parts -------------------------------------------------------------

    @staticmethod
    def _schema(state: dict) -> T.StructType:
        return T.StructType.fromJson(state["schema"])

    def _typed(self, state: dict, rows: DataFrame) -> DataFrame:
        """The table's columns of ``rows``, cast to its types; columns that are absent are null."""
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(state)])

    def _rows(self, state: dict, files: dict[str, list[str]]) -> DataFrame:
        paths = [p for bucket in files.values() for p in bucket]
        schema = self._schema(state)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(state: dict) -> Column:
        return F.pmod(F.xxhash64(state["key"]), F.lit(state["buckets"])).cast("int")

    def _buckets_of(self, state: dict, rows: DataFrame) -> list[str]:
        """The buckets of a request: at most as many numbers as the table has buckets."""
        return [str(r[0]) for r in rows.select(self._bucket(state)).distinct().collect()]

    def _touched(self, state: dict, rows: DataFrame) -> DataFrame:
        touched = set(self._buckets_of(state, rows))
        return self._rows(state, {b: f for b, f in state["files"].items() if b in touched})

    def _write(self, rows: DataFrame, state: dict) -> dict[str, list[str]]:
        """Write rows as new files, and name them by bucket."""
        target = f"{self.path}/data/{uuid.uuid4().hex}"
        checked = rows.filter(F.when(F.col(state["key"]).isNull(), F.raise_error(F.lit(f"null {state['key']}")).cast("boolean")).otherwise(True))
        dealt = checked.withColumn(_BUCKET, self._bucket(state)).repartition(F.col(_BUCKET))
        dealt.write.partitionBy(_BUCKET).parquet(target)
        out: dict[str, list[str]] = {}
        for path in manifest.files(self.spark, f"{target}/{_BUCKET}=*/*.parquet"):
            out.setdefault(path.rsplit("/", 2)[1].removeprefix(f"{_BUCKET}="), []).append(path)
        return out

    def _replace(self, state: dict, requests: DataFrame, rows: DataFrame) -> int:
        touched = self._buckets_of(state, requests)
        return self._publish(state, self._write(rows, state), replaced=touched)

    def _publish(self, state: dict, written: dict[str, list[str]], replaced: list[str]) -> int:
        files = {b: f for b, f in state["files"].items() if b not in set(replaced)}
        for bucket, paths in written.items():
            files[bucket] = [*files.get(bucket, []), *paths]
        version = state["version"] + 1
        manifest.publish(self.spark, f"{self.path}/_versions/{version:012d}.json", {**state, "version": version, "files": files})
        return version
