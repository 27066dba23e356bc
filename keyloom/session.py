"""Session helpers: local sessions for tests, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_STAGED: list[str] = []


def local_session(cores: str | int = "*", app: str = "keyloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and the session is a local one is a temporary folder made.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation, and a plan that uses
    ``df`` twice computes it once. The columns come back in the same order and types.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of the JVM's file system layer, so any scheme Spark can read will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release(spark: SparkSession, path: str) -> bool:
    """Delete a staged path through the file system that holds it."""
    fs, p = _path(spark, path)
    return bool(fs.delete(p, True))


def release_staged(spark: SparkSession) -> int:
    """Delete everything staged so far in this process, once the results that read it are written: how many tables there were."""
    paths, _STAGED[:] = list(_STAGED), []
    for path in paths:
        release(spark, path)
    return len(paths)


class Commits:
    """The committed batches of a folder: a batch counts once its marker is there, and markers are written last.

    A marker is an empty file named by the batch, so a crash before it leaves files that no reader looks at, and a batch
    delivered again finds itself committed. State lives in the folder alone; a new object goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def all(self) -> list[str]:
        fs, p = _path(self.spark, f"{self.folder}/_commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def has(self, name: str) -> bool:
        fs, p = _path(self.spark, f"{self.folder}/_commits/{name}")
        return bool(fs.exists(p))

    def add(self, name: str) -> None:
        fs, p = _path(self.spark, f"{self.folder}/_commits/{name}")
        fs.create(p, True).close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
