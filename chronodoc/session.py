"""Session helpers: building a session, the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; rows and bytes are measured before the hint is given.
BROADCAST_ROWS = 200_000
#: Bytes of their JSON text up to which it may be.
BROADCAST_BYTES = 64 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, checksummed Parquet pages)."""
    b = (
        SparkSession.builder.master(master)
        .appName("chronodoc")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.hadoop.parquet.page.verify-checksum.enabled", "true")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> str:
    """Send this package to executors that cannot import it (clusters without a shared PYTHONPATH)."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="chronodoc-"), "chronodoc.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a laptop) a local
    temporary folder is made and set; on a cluster master an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="chronodoc-shared-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_SCRATCH: list = []  # (FileSystem, Path), which outlive the session they were made in


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``release_scratch`` or when the driver ends."""
    path = f"{shared_dir(spark)}/chronodoc/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(hadoop(spark, path))
    return path


@atexit.register
def release_scratch() -> int:
    """Delete all scratch folders made so far; for long sessions, once the results of earlier queries are no longer
    needed. Returns how many went."""
    gone = 0
    while _SCRATCH:
        fs, p = _SCRATCH.pop()
        try:
            gone += bool(fs.delete(p, True))
        except Exception:  # the JVM may be gone already
            pass
    return gone


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` checkpointed and measured; with a broadcast hint only if it has at most ``max_rows`` rows and its rows,
    written as text, at most ``max_bytes``. Beyond either bound there is no hint."""
    kept = checkpointed(df)
    width = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    small = n <= max_rows and size <= max_bytes
    return (F.broadcast(kept) if small else kept), small
