"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parley")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the folder that the program has set. Only a session on one machine may do without, as in tests: it gets a folder of its own, once. A cluster without a shared folder is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or _OWN.get(context.applicationId)
    if folder:
        return folder
    if (given := context.getCheckpointDir()) is not None:
        return given
    if not context.master.startswith("local"):
        raise RuntimeError("steps are written to a folder that all executors reach: set spark.checkpoint.dir")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table to the shared folder and reads it from there, which cuts the lineage, keeps columns apart and tells the planner how large the step is. The table is deleted when the application ends."""
    where = scratch(df.sparkSession, "step")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream over one of the given parquet tables, a folder of parts or a single file. Streams read folders, so that a file is read as what a pattern matches."""
    where = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(where if parts else f"{sf_dir}/{name}.parque[t]")
