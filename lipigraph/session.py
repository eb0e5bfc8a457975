"""Session defaults, table reading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lipigraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_lipigraph_shipped", False):
        return
    root = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="lipigraph-")) / "lipigraph-package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(at))
    sc._lipigraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core. Files of few row groups would leave cores idle in Python stages; larger inputs pass through unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it names none a local session gets a temporary one; a cluster has to name one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if where is None:
        where = getattr(sc, "_lipigraph_dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if where is None:
            where = sc._lipigraph_dir = tempfile.mkdtemp(prefix="lipigraph-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application below the shared folder. The application's tables go when its context stops."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/lipigraph-{sc.applicationId}"
    if not getattr(sc, "_lipigraph_scratch", False):
        sc._lipigraph_scratch = True
        atexit.register(_remove, sc, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(sc, root: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the context is gone already
        pass


def stable(df: DataFrame) -> DataFrame:
    """df computed once and kept where a lost executor can't take it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stable_table(df: DataFrame, name: str) -> DataFrame:
    """Like stable(), as a compressed columnar table; for wide results that are read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
