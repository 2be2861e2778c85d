"""Listing state and scan log as append-only tables.

Every change is an appended version of a listing; the current state is the latest
version per id. ``max_by`` reduces versions before the shuffle, so an id written very
often costs no more than any other.

Batches of the stream are folded into runs: tables of one version per id over a range of
batches, in folders by hash of the id, sorted, with Parquet's Bloom filters on the id. The
newest run is folded with the one before while that is less than ``GROWTH`` times larger,
so there are few runs and a row is rewritten a logarithmic number of times. A batch asks
the runs only in the folders its ids fall into.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.functions.rules import require_status, status_known
from postsift.schema import (
    LEGACY_STATUS,
    LEGACY_STATUS_BECOMES,
    PURGE_DAYS,
    REJECTS,
    SCAN_LOG,
    STATE,
    STATE_LOG,
)
from postsift.session import broadcast_if_small


def as_versions(rows: DataFrame, version_ts: Column, op_seq: int = 0,
                deleted: bool = False) -> DataFrame:
    """State rows as log versions."""
    return (rows.withColumns({"version_ts": version_ts.cast("timestamp"),
                              "op_seq": F.lit(op_seq).cast("bigint"),
                              "deleted": F.lit(deleted)})
            .select(STATE_LOG.names))


def current_state(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Latest version per id, removed ids left out; only the given columns if any."""
    kept = [c for c in columns or STATE.names if c != "job_id"]
    latest = F.max_by(F.struct(*kept, "deleted"), F.struct("version_ts", "op_seq"))
    return (log.groupBy("job_id").agg(latest.alias("v")).filter(~F.col("v.deleted"))
            .select("job_id", "v.*").drop("deleted"))


def known_ids(log: DataFrame, listings: DataFrame) -> DataFrame:
    """Ids of the listings that the state holds.

    A batch is usually far smaller than the state: its ids are broadcast when they fit,
    so that the log is filtered where it is read instead of being shuffled whole.
    """
    ids = broadcast_if_small(listings.select(F.col("id").alias("job_id")).distinct())
    return current_state(log.join(ids, "job_id", "left_semi"), ["status"]).select("job_id")


def seen_versions(outcomes: DataFrame, as_of: datetime, op_seq: int = 0) -> DataFrame:
    """Versions marking every evaluated listing as seen, whatever its outcome.

    Discovery, notification and status are all reset, as a replacing insert does.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = outcomes.select(
        F.col("id").alias("job_id"), "search_name", "title", "company", "location",
        F.col("job_url").alias("url"), "platform", now.alias("discovered_at"),
        F.when(F.col("status") == "NEW", now).alias("notified_at"), "status")
    return as_versions(rows, now, op_seq)


def set_status(current: DataFrame, job_id: str, status: str, as_of: datetime,
               op_seq: int = 0) -> DataFrame:
    """The version that gives one listing a status; empty when the id is unknown."""
    require_status(status)
    rows = current.filter(F.col("job_id") == job_id).withColumn("status", F.lit(status))
    return as_versions(rows, F.lit(as_of), op_seq)


def status_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``(job_id, new_status)`` rows.

    ``result`` says what became of each: UPDATED, NOT_FOUND or INVALID; updated rows
    carry the state columns with their new status.
    """
    known = current.withColumn("found", F.lit(True))
    result = (F.when(~status_known(F.col("new_status")), "INVALID")
              .when(F.col("found"), "UPDATED").otherwise("NOT_FOUND"))
    joined = updates.join(known, "job_id", "left").withColumn("result", result)
    return joined.withColumn(
        "status", F.when(F.col("result") == "UPDATED", F.col("new_status"))
        .otherwise(F.col("status"))).drop("found", "new_status")


def migrate(legacy: DataFrame) -> DataFrame:
    """Bring an older table to the current columns and status vocabulary."""
    full = legacy.sparkSession.createDataFrame([], STATE).unionByName(
        legacy, allowMissingColumns=True)
    return full.withColumn("status", F.when(F.col("status") == LEGACY_STATUS,
                                            LEGACY_STATUS_BECOMES).otherwise(F.col("status")))


def purged(current: DataFrame, as_of: datetime, days: int = PURGE_DAYS) -> DataFrame:
    """Rows older than the window, which a purge removes."""
    return current.filter(
        F.col("discovered_at") < F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def purge_versions(current: DataFrame, as_of: datetime, days: int = PURGE_DAYS,
                   op_seq: int = 0) -> DataFrame:
    return as_versions(purged(current, as_of, days), F.lit(as_of), op_seq, deleted=True)


STREAM, USER = "stream", "user"

# Folders of a run, by hash of the id.
BUCKETS = 64
# A run is folded with the one before unless that has more than this many times its rows.
GROWTH = 4
# Ids of a batch, up to which they are handed to the scan as values for its Bloom filters.
ASKED_IDS = 1_000
# Small row groups, so that a filter that misses saves most of a file.
ROW_GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Run:
    """A table of the latest versions within a range of stream batches, both ends included."""

    first: int
    last: int
    buckets: int

    @property
    def folder(self) -> str:
        return f"{self.first}-{self.last}-{self.buckets}"

    @staticmethod
    def named(folder: str) -> "Run | None":
        found = re.fullmatch(r"(\d+)-(\d+)-(\d+)", folder)
        return Run(*map(int, found.groups())) if found else None


def bucket_of(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def covering(runs: list[Run], before: int | None) -> list[Run]:
    """Runs without a common batch, newest first, that hold most of the batches before the given one.

    Of runs that end at one batch the longest is taken; runs folded into it are passed over.
    """
    taken, edge = [], before
    for run in sorted(runs, key=lambda r: (-r.last, r.first)):
        if edge is None or run.last < edge:
            taken.append(run)
            edge = run.first
    return taken


class StateTables:
    """Parquet locations of the state log, its runs and the scan log.

    Each batch owns one ``batch_id`` folder of its writer, so writing a batch again after a
    failure replaces what the failed attempt left. Batches of the stream and changes by a
    user (``writer=USER``, numbered on their own) never replace each other. Only batches of
    the stream are folded into runs; a run holds removals too, as they may hide a user's
    change. Folded batches stay where they are and are not read again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        """Names of the folders in a folder; none where it is missing."""
        fs, path = self._files(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self, folder: str) -> list[int]:
        found = [re.fullmatch(r"batch_id=(\d+)", n) for n in self._names(folder)]
        return sorted(int(m[1]) for m in found if m)

    def _read(self, name: str, schema, before: int | None) -> DataFrame:
        if not self._names(name):
            return self.spark.createDataFrame([], schema)
        placed = T.StructType([*schema.fields, T.StructField("writer", T.StringType()),
                               T.StructField("batch_id", T.LongType())])
        rows = self.spark.read.schema(placed).parquet(f"{self.root}/{name}")
        if before is not None:
            # Prunes folders: the batch being written never reads itself.
            rows = rows.filter((F.col("writer") != STREAM) | (F.col("batch_id") < before))
        return rows.drop("writer", "batch_id")

    def _loose(self, before: int | None, folded: list[Run]) -> DataFrame:
        """Versions of the batches that no run of ``folded`` holds; their folders are all that is read."""
        paths = []
        for writer in (STREAM, USER):
            for at in self._numbers(f"state/writer={writer}"):
                if writer == USER or ((before is None or at < before)
                                      and not any(r.first <= at <= r.last for r in folded)):
                    paths.append(self._folder("state", at, writer))
        if not paths:
            return self.spark.createDataFrame([], STATE_LOG)
        return self.spark.read.schema(STATE_LOG).parquet(*paths)

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that are read, newest first. A run counts once it is written whole."""
        fs, path = self._files("runs")
        found = [r for r in map(Run.named, self._names("runs")) if r]
        done = [r for r in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(
            f"{self.root}/runs/{r.folder}/_SUCCESS"))]
        return covering(done, before)

    def _run_rows(self, run: Run) -> DataFrame:
        placed = T.StructType([*STATE_LOG.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(placed).parquet(f"{self.root}/runs/{run.folder}")

    def fold(self, before: int, loose: int = 1) -> list[Run]:
        """Fold the stream's batches before the given one into runs, if at least ``loose`` wait.

        Only batches that are done may be folded: a batch that may be repeated must not meet
        itself. So those in quarantine, like missing numbers, end a run; they can be repeated
        later, are read beside the runs, and are never part of one's range.
        """
        runs, given_up = self.runs(before), set(self._numbers("quarantine"))
        waiting = [b for b in self._numbers(f"state/writer={STREAM}") if b < before
                   and b not in given_up and not any(r.first <= b <= r.last for r in runs)]
        if len(waiting) < loose:
            return []
        spans: list[list[int]] = []
        for at in waiting:
            if spans and spans[-1][1] == at - 1:
                spans[-1][1] = at
            else:
                spans.append([at, at])
        return [self._fold(first, last, runs) for first, last in spans]

    def _fold(self, first: int, last: int, runs: list[Run]) -> Run:
        rows = self.spark.read.schema(STATE_LOG).parquet(
            *[self._folder("state", at, STREAM) for at in range(first, last + 1)])
        size = rows.count()
        for run in runs:
            if run.last != first - 1:
                continue
            older = self._run_rows(run)
            held = older.count()
            if held > GROWTH * size:
                break
            rows, size, first = rows.unionByName(older.drop("bucket")), size + held, run.first
        made = Run(first, last, self.buckets)
        # Partitioned by bucket before the aggregation, so that versions move once.
        latest = (rows.withColumn("bucket", bucket_of(F.col("job_id"), self.buckets))
                  .repartition(self.buckets, "bucket").groupBy("bucket", "job_id")
                  .agg(F.max_by(F.struct(*[c for c in STATE_LOG.names if c != "job_id"]),
                                F.struct("version_ts", "op_seq")).alias("v"))
                  .select("bucket", "job_id", "v.*"))
        (latest.sortWithinPartitions("bucket", "job_id").write.mode("overwrite").partitionBy("bucket")
         .option("parquet.bloom.filter.enabled#job_id", "true")
         .option("parquet.bloom.filter.adaptive.enabled", "true")
         .option("parquet.block.size", str(ROW_GROUP_BYTES))
         .parquet(f"{self.root}/runs/{made.folder}"))
        return made

    def asked_rows(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Versions that may belong to the given ids (``job_id``).

        Of the runs only the folders that ids fall into are read, and for few ids only the
        row groups whose Bloom filters may hold one; numbers of folders, and up to
        ``ASKED_IDS`` ids, are what the driver sees.
        """
        runs = self.runs(before)
        rows = self._loose(before, runs)
        few = ids.limit(ASKED_IDS + 1).collect() if runs else []
        for run in runs:
            part = self._run_rows(run)
            if len(few) <= ASKED_IDS:
                asked = self.spark.createDataFrame(few, ids.schema)
                part = part.filter(F.col("job_id").isin([r.job_id for r in few]))
            else:
                asked = ids
            hit = [r.bucket for r in asked.select(
                bucket_of(F.col("job_id"), run.buckets).alias("bucket")).distinct().collect()]
            rows = rows.unionByName(part.filter(F.col("bucket").isin(hit)).drop("bucket"))
        return rows

    def known(self, listings: DataFrame, before: int | None = None) -> DataFrame:
        """Ids of the listings that the state holds (``job_id``)."""
        ids = listings.select(F.col("id").alias("job_id")).where("job_id IS NOT NULL").distinct()
        return known_ids(self.asked_rows(ids, before), listings)

    def _folder(self, name: str, batch_id: int, writer: str) -> str:
        return f"{self.root}/{name}/writer={writer}/batch_id={batch_id}"

    def state_log(self, before: int | None = None) -> DataFrame:
        """All versions that count: those of the runs, and of the batches in none."""
        runs = self.runs(before)
        rows = self._loose(before, runs)
        for run in runs:
            rows = rows.unionByName(self._run_rows(run).drop("bucket"))
        return rows

    def state(self, before: int | None = None, columns: list[str] | None = None) -> DataFrame:
        return current_state(self.state_log(before), columns)

    def scans(self, before: int | None = None) -> DataFrame:
        return self._read("scans", SCAN_LOG, before)

    def append_state(self, versions: DataFrame, batch_id: int, writer: str = STREAM) -> None:
        versions.write.mode("overwrite").parquet(self._folder("state", batch_id, writer))

    def rejects(self) -> DataFrame:
        """What cycles could not use, with the reason."""
        return self._read("rejects", REJECTS, None)

    def append_rejects(self, rows: DataFrame, batch_id: int, writer: str = STREAM) -> None:
        rows.write.mode("overwrite").parquet(self._folder("rejects", batch_id, writer))

    def quarantine(self, rows: DataFrame, batch_id: int) -> None:
        """Keep the rows of a batch that failed as they landed, to be run again later."""
        rows.write.mode("overwrite").parquet(f"{self.root}/quarantine/batch_id={batch_id}")

    def quarantined(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/quarantine/batch_id={batch_id}")

    def append_scans(self, rows: DataFrame, batch_id: int, writer: str = STREAM) -> None:
        rows.write.mode("overwrite").parquet(self._folder("scans", batch_id, writer))

    def compacted(self, target: str) -> "StateTables":
        """Write the current state and scan log to a new root, one version per id."""
        other = StateTables(self.spark, target)
        latest = self.state_log().groupBy("job_id").agg(
            F.max_by(F.struct("*"), F.struct("version_ts", "op_seq")).alias("v"))
        other.append_state(latest.select("v.*").filter(~F.col("deleted")), 0)
        other.append_scans(self.scans(), 0)
        return other

    def reset(self, batch_id: int, as_of: datetime, writer: str = USER) -> None:
        """Remove every listing by tombstones and clear the scan log."""
        self.append_state(as_versions(self.state(), F.lit(as_of), 1 << 40, deleted=True),
                          batch_id, writer)
        self.spark.createDataFrame([], SCAN_LOG).write.mode("overwrite").parquet(
            f"{self.root}/scans")
