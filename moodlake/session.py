"""Spark session defaults and the shared scratch/checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
    # streaming state (1-day dedup keys, open windows) lives in RocksDB on local
    # disk with incremental changelog checkpoints, not in the executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streaming state off the heap also in a session that was made elsewhere (a provider set there is kept)."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _DEFAULTS[_PROVIDER])


_SHIPPED: set[str] = set()  # applications that have the package's sources


def get_session(master: str | None = None, app: str = "moodlake",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Builder with the engine's defaults. On a cluster the master and the
    checkpoint folder come from the submit configuration; locally (tests, bench)
    they are filled in here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Unset, a local session (tests) gets a private folder; on a cluster that
    would be a path of the driver alone, so it is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="moodlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():  # setting it again would open a folder inside the folder
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started: once per application, its
    sources travel as a zip file through ``addPyFile``. An installed package makes this redundant, not wrong."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="moodlake-src-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path under the checkpoint root (never reused, never cleared)."""
    root = checkpoint_root(spark)
    return f"{root}/moodlake-{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
