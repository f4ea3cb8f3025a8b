"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "vqaframe",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (about
    128-256 MB per partition), AQE coalesces the small ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to a shared file system. Only when
    it is unset (local runs, tests) a private folder is created and
    registered, so that ``DataFrame.checkpoint`` works everywhere.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="vqaframe-ckpt-")
    sc.setCheckpointDir(local)
    return local


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable (not local) checkpoints survive executor loss.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its (possibly remote) file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def ensure(df, condition, message):
    """Fail the job on the first row where ``condition`` does not hold.

    The check is a filter, so no column pruning removes it; it is marked
    non-deterministic so that it stays above the joins below it.
    """
    from pyspark.sql import functions as F
    failed = F.raise_error(message).cast("boolean")
    return df.filter(F.when(condition, F.monotonically_increasing_id() >= 0).otherwise(failed))


def spread_narrow(df):
    """Round-robin a DataFrame whose scan has fewer partitions than cores.

    A table stored as one large row group is read by a single task; heavy
    per-row work (tokenising, exploding) would then run on one core. When the
    input already has at least as many partitions as the cluster has cores
    (every large table on a real cluster) this returns ``df`` unchanged, so no
    shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]):
    """A small DataFrame of literal rows built on the JVM (no Python worker).

    ``createDataFrame`` from a Python list plans as a Python RDD; every job
    that touches it would start Python workers. Use only for bounded inputs
    (a handful of special tokens, one row per partition).
    """
    from pyspark.sql import functions as F
    idx = (F.col("id") + 1).cast("int")
    cols = []
    for j, (name, dtype) in enumerate(schema):
        arr = F.array(*[F.lit(r[j]).cast(dtype) for r in rows]) if rows else F.array().cast(f"array<{dtype}>")
        cols.append(F.element_at(arr, idx).cast(dtype).alias(name))
    return spark.range(len(rows)).select(*cols)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Functions that run in Python workers (mapInPandas) refer to package
    modules; workers on other machines, or started from another working
    directory, cannot import them. The package is zipped on the driver and
    registered with ``addPyFile``, which Spark copies to every executor,
    the same as ``--py-files``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="vqaframe-pyfiles-"), "vqaframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
