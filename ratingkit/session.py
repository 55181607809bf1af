"""Spark session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Settings every entry point wants.  AQE re-plans joins from runtime sizes (the only
# broadcast decisions we leave to Spark are the size-checked ones it makes itself),
# coalesces small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoints nobody refers to any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "ratingkit", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make reliable checkpoints usable.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.  Only a
    local-mode session without that setting (tests, the bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not (sc.master == "local" or sc.master.startswith("local[")):      # local-cluster is a cluster
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    path = tempfile.mkdtemp(prefix="ratingkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Shuffle files of the frames made and run in here are deleted when their action ends.

    Otherwise they stay until the driver's JVM collects garbage, so the steps of a long job add up on disk.
    """
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so a lost executor never replays the chain."""
    ensure_checkpoint_dir(df.sparkSession)
    with dropped_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)      # a frame made in here


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ratingkit`` importable in Python workers (Arrow UDFs, ``mapInPandas``).

    Zips the package once per application and registers it with ``addPyFile``; Spark then
    serves it to every executor, so nothing depends on the workers' ``PYTHONPATH``.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ratingkit-py-"), "ratingkit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


# Folders of stored frames, to delete those that nothing reads any more.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back: a lineage cut that
    later reads can prune by column and filter."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with dropped_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames.  No frame that is still to run may read them."""
    for df in frames:
        path = _FOLDERS.pop(df)
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
