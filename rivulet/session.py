"""Session construction and cluster-level settings.

The library never assumes a local filesystem: lineage cuts go to the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that setting is absent
(unit tests, local benches) do we point it at a fresh scratch folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on.  UTC keeps timestamp arithmetic and the
# DuckDB oracle in agreement; AQE coalesces small shuffles and splits skewed
# join partitions at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A union of two children hash-partitioned alike may otherwise report that
    # partitioning while holding twice the partitions; with AQE coalescing this
    # fails sort-merge joins downstream ("Can't zip RDDs").  Keep the default.
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rivulet", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    # Local runs only: bind the driver to loopback.
    conf["spark.driver.host"] = "127.0.0.1"
    conf["spark.driver.bindAddress"] = "127.0.0.1"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``rivulet`` importable in Python workers (pandas UDFs, ``mapInPandas``), once per context.

    The package is zipped and added with ``addPyFile``, Spark's own code
    distribution, so executors never depend on the driver's working directory.
    """
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_rivulet_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="rivulet-pkg-")
    archive = shutil.make_archive(os.path.join(out, "rivulet"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    sc._rivulet_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL settings to a session we did not build ourselves."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.execution.arrow.pyspark.enabled", "spark.sql.unionOutputPartitioning"):
        try:
            spark.conf.set(k, BASE_CONF[k])
        except Exception:  # static conf on some deployments
            pass
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="rivulet-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def bucketed_table(df: DataFrame, key: str, buckets: int | None = None, prefix: str = "rivulet") -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` in the shared checkpoint folder and read it back.

    Scans of a bucketed table report their hash partitioning, so joins with a
    broadcast side and aggregations that include ``key`` run without a shuffle
    of this table.
    """
    import uuid

    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{prefix}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    df.write.mode("overwrite").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One computation (a reliable ``checkpoint()`` recomputes its input unless it
    is cached), columnar re-reads, and a plan that starts from the written
    table - so a lost executor re-reads files instead of replaying the
    lineage.  Never ``localCheckpoint``.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    for opened in _scratch.get():
        opened.append(path)
    return df.sparkSession.read.parquet(path)


# Lists of the tables that open ``scratch_tables`` blocks of this thread will remove.
_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Remove the tables that ``cut_lineage`` writes inside the block, for jobs that repeat for ever; results must be stored by then."""
    mine: list[str] = []
    token = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
