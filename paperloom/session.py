"""Session settings, and the one way this library cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators rely on. All can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_cut_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    local = spark.sparkContext.master.startswith("local")
    if local and spark.conf.get("spark.sql.shuffle.partitions") == "200":  # the untouched default
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "paperloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder. On a cluster that
    folder would exist on one machine only, so the setting is required there.
    """
    app = spark.sparkContext.applicationId
    if app in _cut_roots:
        return _cut_roots[app]
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    _cut_roots[app] = f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    return _cut_roots[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{cut_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The plan above becomes a plain scan, so iterative jobs stay flat; the files
    outlive any executor; and the scan carries real sizes for join planning.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    Only acts when the scan has fewer splits than the session has cores, so a
    table of many files is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pin(df: DataFrame, **computed: Column) -> DataFrame:
    """Add computed columns that are evaluated exactly once per row.

    Filters on a plain computed column, also those Spark infers below an
    explode, move under the projection and repeat its expression. A one-element
    generator stops that; it adds no exchange.
    """
    values = F.array(F.struct(*[c.alias(name) for name, c in computed.items()]))
    return df.select("*", F.inline(values))


def drop_cuts(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    root = _cut_roots.pop(spark.sparkContext.applicationId, None)
    if root:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
