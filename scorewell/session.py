"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
#: Small tables are written by so many tasks a core, larger ones by as many as there are for this many rows of what they are made from.
TASKS_PER_CORE, ROWS_PER_FILE = 4, 2048


def build_session(app_name: str = "scorewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as its time zone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it then gets a fresh temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    # The setting cannot be changed in a running session, so the folder is remembered here.
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="scorewell-")
    return _local_folders[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scorewell/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder, in this application's own part, that nothing has been written to yet."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard_stages(spark: SparkSession) -> bool:
    """Delete everything this application has put below the shared folder.

    Call it once the results that read those tables have been written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few_files(spark: SparkSession, rows: int) -> int:
    """In how many files a table made from so many rows goes at most: some for each core, and more only with the rows."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_FILE))


def materialize(df: DataFrame, name: str = "stage", files: int | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets later passes prune columns. With ``files``, tasks take several
    partitions each where there are more: without Hadoop's native library an executor starts some six processes for each
    local file, and each shares the executor's whole memory until it runs its program.
    """
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
