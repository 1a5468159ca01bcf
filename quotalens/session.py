"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows one task may sort on its own. Larger inputs go through score buckets or range slices.
ROWS_PER_TASK = 1_000_000

_LOCAL_FOLDER = "quotalens.local.folder"
_RUN_FOLDER = "quotalens.run.folder"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "quotalens", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.files.maxPartitionBytes": "16m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster without it is refused: a
    machine-local folder would lose the table with the machine. Inside :func:`run_scope` it is the run's own folder.
    """
    own = spark.conf.get(_RUN_FOLDER, None)
    if own:
        return own
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_FOLDER, None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_LOCAL_FOLDER, folder)
    return folder


def colocated_prefix(spark: SparkSession) -> str:
    """How the names of bucketed tables begin, within a run with the run's own mark."""
    own = spark.conf.get(_RUN_FOLDER, None)
    return f"colocated_{own.rsplit('-', 1)[-1]}_" if own else "colocated_"


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables of a run, deleted at the end. Write results elsewhere before it ends."""
    outer = spark.conf.get(_RUN_FOLDER, None)
    folder = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    spark.conf.set(_RUN_FOLDER, folder)
    try:
        yield folder
    finally:
        for table in spark.catalog.listTables(pattern=f"{colocated_prefix(spark)}*"):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
        spark.conf.set(_RUN_FOLDER, outer) if outer else spark.conf.unset(_RUN_FOLDER)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for a spread that must not be coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends instead of when the driver collects garbage. Results must be written down there."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, or in ``folder``, and read it back.

    Cuts the lineage in a way that survives lost executors, pins anything that depends on task placement,
    and gives the optimizer the true size, so that a later join broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
