"""Session construction, shipping of the package, and the scale guards every plan shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when both its rows and its bytes are counted to fit.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
# Tasks that groups of few bytes are dealt over.
MOST_TASKS = 2000
# Pages and texts grow to many times their size as Python objects, so a batch is bounded in bytes.
PYTHON_BATCH_BYTES = "2m"


def build_session(app: str = "postsift", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", PYTHON_BATCH_BYTES)
        # Lists of ids reach the Bloom filters of Parquet as values, not as a range.
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    ship_package(session)
    return session


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application.

    Python functions are sent by reference, so workers must be able to import the
    package wherever the driver was started from.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="postsift-package-")) / "postsift"
        context.addPyFile(shutil.make_archive(str(archive), "zip", root.parent, root.name))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster the
    folder has to be visible to every executor, so a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            shared = tempfile.mkdtemp(prefix="postsift-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own in the shared folder, read again."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS,
                   size: int = BROADCAST_BYTES) -> bool:
    """Measure a side against both bounds, reading at most ``rows + 1`` rows."""
    used = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    count, used = df.limit(rows + 1).agg(F.count("*"), used).first()
    return count <= rows and (used or 0) <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only when the side is measured to be within the bounds.

    Past them no hint is given and the join shuffles on its keys, where adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if fits_broadcast(df) else df


def dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows dealt over tasks for ``groups`` groups of ``keys``, two tasks for each group up to ``MOST_TASKS``.

    For groups of few bytes that take long: adaptive execution would put many of them into
    one task, which goes by bytes, and leaves a given number of tasks as it is.
    """
    return df.repartition(max(1, min(2 * groups, MOST_TASKS)), *keys)


def configure(spark: SparkSession) -> None:
    """Settings the plans rely on, for a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PYTHON_BATCH_BYTES)
