"""Removal of repeated lines with levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm.common import shared_path

#: White space that a line key loses at both ends.
_BLANK = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column, min_chars: int) -> Column:
    """Per line the hash of its key, null where the key is shorter than ``min_chars`` code points."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(_BLANK))
        return F.when(F.length(bare) >= min_chars, F.xxhash64(F.translate(bare, _UPPER, _LOWER)))

    return F.transform(lines, key)


class LineRuns:
    """Runs of (line hash, documents, last document), sorted by hash, in levels of a shared folder.

    Each batch adds one run to level 0. As soon as a level holds ``fanout`` runs they are merged into one run of the
    next level, so ``n`` batches leave about ``fanout * log(n)`` runs and every hash is rewritten ``log(n)`` times. A
    run is a table of its own and is never changed: a repeated or lost task rewrites files, not state.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, path: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or shared_path(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self._written = 0

    def _write(self, run: DataFrame) -> DataFrame:
        path = f"{self.path}/run-{self._written}"
        self._written += 1
        run.sortWithinPartitions("hash").write.parquet(path)
        return self.spark.read.schema(run.schema).parquet(path)

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Add a run, compacting every level that is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(self.merge(full), level + 1)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def seen(self) -> DataFrame | None:
        """All runs merged: one row per line hash."""
        return self.merge(runs) if (runs := self.runs()) else None


def _profile(docs: DataFrame, id_column: str, min_chars: int) -> DataFrame:
    return docs.select(F.col(id_column).alias("_doc"), F.array_distinct(F.array_compact("_keys")).alias("_keys"))


def _run(docs: DataFrame, id_column: str, min_chars: int) -> DataFrame:
    keys = _profile(docs, id_column, min_chars).select("_doc", F.explode("_keys").alias("hash"))
    return keys.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_doc").alias("last"))


def add_batch(runs: LineRuns, batch: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """Drop the lines of a new batch that earlier batches hold, and add the batch's own lines as a run.

    The result is planned against the runs before the batch, so it stays the same after later batches. Within a batch
    a repeated line stays only in the row with the largest id. See ``drop_repeated_lines`` for the edge cases.
    """
    keyed = batch.withColumn("_keys", line_keys(F.col(text), min_chars))
    own = _run(keyed, id_column, min_chars)
    before = runs.seen()
    repeated = own.filter("n_docs > 1").select("hash", "last")
    if before is not None:
        repeated = repeated.join(before.select("hash"), "hash", "left_anti").unionByName(
            own.join(before.select("hash"), "hash", "left_semi").select("hash", F.lit(None).cast(own.schema["last"].dataType).alias("last"))
        )
    out = _strip(keyed, repeated, id_column, text)
    runs.add(own)
    return out


def _strip(keyed: DataFrame, repeated: DataFrame, id_column: str, text: str) -> DataFrame:
    """Drop the lines whose hash is in ``repeated(hash, last)`` from all rows but those with id ``last``.

    Only hashes and ids are joined; the texts are then met once by the few rows that lose a line.
    """
    keys = keyed.select(
        F.col(id_column).alias("_doc"), F.xxhash64(F.col("_keys")).alias("_lines"),
        F.explode(F.array_distinct(F.array_compact("_keys"))).alias("hash"),
    )
    hit = keys.join(repeated, "hash").filter(~F.col("_doc").eqNullSafe(F.col("last")))
    lost = hit.groupBy("_doc", "_lines").agg(F.collect_set("hash").alias("_lost")).withColumnRenamed("_lines", "_their_lines")
    joined = keyed.join(
        lost, F.col(id_column).eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col("_keys")) == F.col("_their_lines")), "left"
    )
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("_lost", F.get("_keys", i)), F.lit(False)))
    gone = F.size(lines) - F.size(kept)
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(gone).cast("long"),
            text: F.when(F.col("_lost").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("_keys", "_doc", "_lost", "_their_lines")


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 8, fanout: int = 4
) -> DataFrame:
    """Lines whose key is found in ``min_docs`` rows or more stay only in the row with the largest id.

    The key is the line without ASCII white space at its ends, A-Z lower-cased; shorter keys never count. The input is
    added to the runs in ``batches`` (by id); the compacted runs are then merge-joined with the lines of all rows.
    Adds ``n_lines`` and ``n_dropped``; ``text`` loses the dropped lines.

    Null text is one empty line and stays null. A null id counts as the smallest; where it is also the largest id of a line (all null) no row loses
    the line. A line counts once per row however often it stands there; rows that repeat an id are rows of their own,
    and all rows with the largest id keep the line. An empty table gives no rows, a row that loses all lines keeps an
    empty text, other columns pass through. Columns named ``_keys``, ``_doc``, ``_lost``, ``_their_lines`` are reserved.
    """
    keyed = docs.withColumn("_keys", line_keys(F.col(text), min_chars))
    runs = LineRuns(docs.sparkSession, fanout)
    # one scan writes the runs of all batches: a batch is a group of files
    every = _profile(keyed, id_column, min_chars).select(
        "_doc", F.pmod(F.xxhash64("_doc"), F.lit(batches)).cast("int").alias("batch"), F.explode("_keys").alias("hash")
    )
    path = f"{runs.path}/batches"
    every.groupBy("batch", "hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_doc").alias("last")).sortWithinPartitions(
        "batch", "hash"
    ).write.partitionBy("batch").parquet(path)
    schema = every.select("hash", F.lit(1).cast("long").alias("n_docs"), F.col("_doc").alias("last")).schema
    found = docs.sparkSession.read.schema(schema.add("batch", "integer")).parquet(path)
    for low in range(0, batches, fanout):  # level 0 is full as soon as fanout batches are there
        runs.add(LineRuns.merge([found.filter(F.col("batch") == k).drop("batch") for k in range(low, min(batches, low + fanout))]), 1)
    repeated = runs.seen().filter(F.col("n_docs") >= min_docs).filter(F.col("last").isNotNull()).select("hash", "last")
    return _strip(keyed, repeated, id_column, text)
