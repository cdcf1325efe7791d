"""Session settings the library relies on, and the shared folder for checkpoints and streaming state."""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Folders below the shared one made by this process.
_MADE = []


def local_session(cpus="*", app="tapeline", partitions=8, memory="12g"):
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark):
    """Apply the runtime settings that results depend on (UTC timestamps)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark):
    """Folder every executor can reach: the cluster's checkpoint folder. Only a local master may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    path = tempfile.mkdtemp(prefix="tapeline-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark, name):
    """A fresh folder below the shared one."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _MADE.append(path)
    return path


def _delete(spark, path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark):
    """Remove the folders made so far. Results that still read them must have been written elsewhere by then."""
    while _MADE:
        _delete(spark, _MADE.pop())


def discard(df):
    """Remove the folder of one ``cut`` that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if own := [p for p in _MADE if path.endswith(p.split("://")[-1])]:
            _MADE.remove(own[0])
            _delete(df.sparkSession, own[0])


@contextlib.contextmanager
def tidy(spark):
    """What is written in here is packed more tightly, and its shuffle files go when it is written; else they stay until the driver happens to collect its garbage."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    old = {k: spark.conf.get(k, None) for k in own}
    put = lambda k, v: spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for k, v in own.items():
        put(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            put(k, v)


def cut(df, name="cut"):
    """Write a result to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
