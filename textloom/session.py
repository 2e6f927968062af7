"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_marked: set[str] = set()

#: Inputs below this size may be dealt anew to use all cores.
SMALL_INPUT = 256 << 20
#: Names of written tables of texts, whose size counts: zstd leaves a third less of them.
TEXTS = frozenset({"parsed", "sent", "words", "counts"})


def local_session(app: str = "textloom", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local master gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="textloom-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's part of the shared folder, which is deleted
    when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    folder = f"{work_dir(spark)}/textloom-{app}"
    if app not in _marked:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(app)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def computed(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds costly columns that are worked out once per row.

    A generator yields them, because filters on an ordinary projected column
    move below the projection and repeat its expression.
    """
    one = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select("*", F.inline(one))


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """The rows written once to the shared folder and read back.

    For a frame with several uses: it is computed once, survives lost
    executors, and gives the next plan a short lineage and real sizes. Tables of
    texts are told by ``name``.
    """
    path = new_path(df.sparkSession, name)
    (df.write.option("compression", "zstd") if name in TEXTS else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a small input, whose file may have a single split.

    At most SMALL_INPUT bytes are moved; a larger input has splits enough and
    keeps them. The size comes from the file listing, without a job.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) < SMALL_INPUT:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return df
