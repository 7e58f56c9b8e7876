"""Session settings, the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold for a single group before the split forms are used.
HOT_ROWS_KEY = "spark.furrow.hotGroupRows"
HOT_ROWS_DEFAULT = 1_000_000

_LOCAL_ROOT: list[str] = []


def local_session(cores: str = "8", name: str = "furrow") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names.

    Only a local session without the setting falls back to a temporary folder;
    anywhere else a machine-local folder would not be visible to all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="furrow-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], ignore_errors=True)
    return _LOCAL_ROOT[0]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this application has written; call it when a job ends.

    Frames built on them can't be read afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/furrow/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Ends the lineage with files that outlive a lost executor, and fixes values that
    a recomputation could change (sampled range bounds, partition ids).
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/furrow/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
