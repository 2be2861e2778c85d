"""The polling loop as a Structured Streaming query over landed files.

Every micro-batch is one scan cycle against the state left by earlier batches. The
state is a table kept for ever, as parity demands, so it is joined inside
``foreachBatch``; ``bounded_unseen`` is the variant with a watermark.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postsift.operators.alerts import alert_bodies, alert_envelopes, write_alerts
from postsift.operators.similar import greedy_dedup
from postsift.operators.state import (
    StateTables,
    current_state,
    seen_versions,
)
from postsift.plans.scan import scan
from postsift.schema import LISTING, REJECTS, SCAN_LOG, Settings
from postsift.session import broadcast_if_small, ship_package
from postsift.sources.profiles import effective_pages
from postsift.sources.registry import SOURCES, union_sources
from postsift.sources.rejects import (
    BATCH_FAILED,
    SHOWN,
    SOURCE_FAILED,
    lost_searches,
    payload_reason,
    payload_rejects,
    reject_rows,
)

log = logging.getLogger("postsift")

# What similarity dedup reads of the state.
_TITLE_COLUMNS = ["title", "company", "status", "discovered_at"]


@dataclass
class Poller:
    """What a cycle needs besides its listings."""

    profiles: DataFrame
    settings: Settings
    tables: StateTables
    alerts_root: str
    details: DataFrame | None = None
    # None reads the clock once per batch.
    as_of: datetime | None = None
    dedup: Callable[[DataFrame, DataFrame], DataFrame] = greedy_dedup
    # Batches of state that wait before they are folded into a run; None folds none.
    fold_every: int | None = 64

    def __post_init__(self):
        ship_package(self.profiles.sparkSession)

    def run(self, listings: DataFrame, batch_id: int) -> None:
        """One cycle. Alerts go out before state is written, and all three outputs
        replace what an earlier attempt at the same batch left behind."""
        started = time.monotonic()
        as_of = self.as_of or datetime.now(timezone.utc)
        settings = replace(self.settings, as_of=as_of)
        # Earlier batches are done once this one starts.
        if self.fold_every:
            self.tables.fold(batch_id, self.fold_every)
        states = self.tables.state_log(before=batch_id)
        cycle = scan(listings, self.profiles, current_state(states, _TITLE_COLUMNS), settings,
                     self.details, self.dedup, self.tables.known(listings, batch_id))
        outcomes = cycle.outcomes.persist()
        try:
            columns = ["profile_ord", "embed_color", "webhook_url", "role_id_to_mention"]
            sent = outcomes.filter(F.col("status") == "NEW").join(
                broadcast_if_small(self.profiles.select(columns)), "profile_ord")
            write_alerts(alert_bodies(alert_envelopes(sent, settings)), self.alerts_root, batch_id)
            self.tables.append_state(seen_versions(outcomes, as_of, batch_id), batch_id)
            counters = cycle.counters.withColumns({
                "timestamp": F.lit(as_of),
                "duration_seconds": F.lit(time.monotonic() - started)})
            self.tables.append_scans(
                counters.select(*[F.col(f.name).cast(f.dataType) for f in SCAN_LOG.fields]), batch_id)
        finally:
            outcomes.unpersist()
            cycle.release()

    def run_payloads(self, payloads: DataFrame, batch_id: int) -> None:
        """One cycle from raw responses: extract every registered source first.

        Responses that cannot be read, sources that fail and listings of lost searches are
        written as rejects; the others go on.
        """
        profiles = effective_pages(self.profiles, self.settings)
        good = payloads.where(payload_reason().isNull())
        landed = {code: good.filter(F.col("platform_code") == code) for code in SOURCES}
        listings, failed = self._extracted(landed, profiles)
        try:
            self.run(listings, batch_id)
            rejects = payload_rejects(payloads).unionByName(lost_searches(listings, self.profiles))
            for code, error in failed.items():
                rejects = rejects.unionByName(reject_rows(landed[code], F.lit(SOURCE_FAILED), F.lit(error)))
            self.tables.append_rejects(rejects, batch_id)
        finally:
            listings.unpersist()

    def _extracted(self, landed: dict[str, DataFrame], profiles: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Listings of all sources, parsed once and kept on disk, and the errors of sources that failed.

        All are read together; only where that fails is each tried on its own.
        """
        failed: dict[str, str] = {}
        for retry in (False, True):
            listings = None
            try:
                listings = union_sources(
                    {code: rows for code, rows in landed.items() if code not in failed}, profiles).persist(StorageLevel.DISK_ONLY)
                listings.count()
                return listings, failed
            except Exception as error:
                if listings is not None:
                    listings.unpersist()
                if retry:
                    raise
                log.warning("sources are read one by one: %s", str(error)[:SHOWN])
            for code, rows in landed.items():
                try:
                    union_sources({code: rows}, profiles).write.format("noop").mode("overwrite").save()
                except Exception as error:
                    failed[code] = str(error)[:SHOWN]
        raise AssertionError("unreachable")


def outliving(run: Callable[[DataFrame, int], None], tables: StateTables) -> Callable[[DataFrame, int], None]:
    """``run`` for a query that goes on after a failed batch.

    The batch's rows are kept as they landed, and a reject tells of them. Only the batch
    is given up: ``run(tables.quarantined(n), n)`` repeats it under its own number.
    """
    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            run(batch, batch_id)
        except Exception as error:
            log.exception("batch %s failed", batch_id)
            tables.quarantine(batch, batch_id)
            spark = batch.sparkSession
            tables.append_rejects(spark.createDataFrame(
                [(None, None, None, BATCH_FAILED, str(error)[:SHOWN])], REJECTS), batch_id)
    return guarded


def landed_files(spark: SparkSession, path: str, schema: StructType = LISTING,
                 file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file source; each new file is read once."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
          interval_minutes: int | None = None) -> StreamingQuery:
    """Run cycles every interval, or once over all that has landed when none is given.

    A failed cycle ends the query and is repeated on restart from the checkpoint under the
    same batch id; with ``outliving(run, tables)`` the query goes on.
    """
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if interval_minutes is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_minutes} minutes").start()


def bounded_unseen(stream: DataFrame, landed_at: str, horizon: str) -> DataFrame:
    """Ids not met within the horizon, with state that expires behind a watermark.

    The watermark follows landing time, which every row has, so listings without a
    posting time are never dropped. An id returning after the horizon is new again.
    """
    return stream.withWatermark(landed_at, horizon).dropDuplicatesWithinWatermark(["id"])
