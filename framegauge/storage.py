"""Shared-folder checkpoints for results that must not be recomputed.

Approximate sketches give other numbers when they are evaluated twice, and
iterative jobs grow their lineage.  Both are cut with ``checkpoint()``, which
writes to the shared folder named by ``spark.checkpoint.dir`` and therefore
survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is set."""
    configured = spark.conf.get(_SETTING, None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"Set {_SETTING} to a folder that all machines share.")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="framegauge-"))
    return configured or context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table this session writes."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
