"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings stay as the cluster has them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent on a local master (tests) is a temporary folder made and set; a cluster needs it.
    """
    folder = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT, None)
    if not folder:
        own = spark.sparkContext.getCheckpointDir()
        if own:
            return own
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most so many rows at once from here on: whole texts are long, and both sides of the pipe
    hold a batch several times over. A lower setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a read of it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later read needs, as soon as what was made of them is written itself. Spark's
    cleaner removes the shuffle files of finished queries when the driver collects garbage, so that is asked for too."""
    for df in tables:
        spark = df.sparkSession
        jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished queries."""
    spark.sparkContext._jvm.System.gc()
