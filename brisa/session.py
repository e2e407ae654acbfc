"""Session construction and the shared scratch location.

Intermediate tables (CSV round trips, stream sinks, checkpoints) go under the
folder the cluster names in ``spark.checkpoint.dir``.  We only choose our own
location when the session leaves it unset (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming session windows: merge sessions inside each input partition before
    # the shuffle, so an entity dominating a micro-batch ships sessions, not events
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "brisa", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session; set a local one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, use the session setting
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):  # executors would write to their own disks
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        configured = tempfile.mkdtemp(prefix="brisa-ckpt-")  # local tests only
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: list[str] = []  # folders that this process has asked for


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/brisa/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables asked for by this process (after the first ``since``).

    Results that were not read to the end yet need theirs: call it when the work is done.
    """
    while len(_SCRATCH) > since:
        remove_path(spark, _SCRATCH.pop())


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables asked for inside go at the end: for work that is written out by then."""
    since = len(_SCRATCH)
    try:
        yield
    finally:
        drop_scratch(spark, since)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``brisa`` importable in the Python workers (the codec and stateful
    operators run there), as ``--py-files`` would: zip the package once per
    SparkContext and add it with ``addPyFile``, which distributes it to every
    executor."""
    import os
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship the package with the server's Python env
        return
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="brisa-pyfiles-"), "brisa.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(id(sc))
