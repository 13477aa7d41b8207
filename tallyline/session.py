"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(
    app_name: str = "tallyline", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings every operator assumes: UTC and adaptive execution.

    Recording the Python line of every expression is off, since it costs more than building the plans.

    Cluster sizing (shuffle partitions, memory, split size) stays with the deployment; pass it in ``settings``
    or set it in the cluster's own defaults.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, where lineage is cut.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
    folder; a cluster session without it is an error, because a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that every executor can read")
        folder = tempfile.mkdtemp(prefix="tallyline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
