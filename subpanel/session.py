"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that change plans, not results; all may be overridden by the cluster's own configuration.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "subpanel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join handling on; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of a large table that one shuffle partition or stored file is to hold, about 50 MB in memory.
ROWS_PER_PART = 300_000
_SHUFFLE = "spark.sql.shuffle.partitions"


def parts_for(spark: SparkSession, rows: int, per_part: int = ROWS_PER_PART) -> int:
    """Partitions or files for so many rows: as many as the session shuffles into, more when the rows need more.

    A fixed number would let the rows of a task grow with the tables until sorts spill.
    """
    return max(int(spark.conf.get(_SHUFFLE)), -(-rows // per_part))


@contextmanager
def shuffling_into(spark: SparkSession, least: int | None) -> Iterator[None]:
    """What is written inside shuffles into `least` partitions at least; the session's setting comes back after."""
    if least is None or int(spark.conf.get(_SHUFFLE)) >= least:
        yield
        return
    with setting(spark, _SHUFFLE, least):
        yield


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """One setting for what is written inside; the session's own comes back after."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it (harmless where it is installed)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors for stage tables.

    It is the cluster's ``spark.checkpoint.dir``. Only a local-mode session, where driver and
    executors are one process, falls back to a folder of its own.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/subpanel-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="subpanel-", dir=os.environ.get("SUBPANEL_SCRATCH"))
    return _local_dirs[app]
