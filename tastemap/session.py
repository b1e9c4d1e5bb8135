"""Spark session helpers.

The library never creates its own cluster configuration: on a cluster the
session comes from the caller.  ``local_session`` is for tests, the bench and
the driver smoke check only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the recommenders rely on (AQE re-plans joins from measured sizes,
# splits skewed shuffle partitions and coalesces tiny ones).
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tastemap") -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    shuffle_partitions = shuffle_partitions or cores
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TASTEMAP_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (tests, a laptop) do we pick a scratch folder of our own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(iterative operators checkpoint their state there)")
        # one-process local mode only (tests, a laptop): a scratch folder of our own
        configured = tempfile.mkdtemp(prefix="tastemap-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as compressed columns in the checkpoint folder (in ``path`` if given), read back.

    The shuffle files of the job that writes it are deleted when it ends: what is read from then on are the columns.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings to start a cluster session with, sized from the input volume.

    Shuffle partitions are chosen so that one partition is about
    ``target_partition_bytes`` of shuffled input (at least two waves of tasks
    over all cores); AQE then coalesces small partitions and splits skewed
    ones at run time.  ``spark.checkpoint.dir`` is not set here: it must name
    a folder shared by the cluster.
    """
    partitions = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        **RUNTIME_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


#: Whether the shuffle files of a job are deleted when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tastemap`` importable in the Python workers.

    Kernels run inside Arrow UDFs and refer to functions of this package, so
    every executor needs it on its path: the package is zipped once per
    process and added with ``SparkContext.addPyFile`` (Spark distributes it to
    the executors).  A no-op when already shipped to this context.
    """
    import os
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions ship code differently
        return
    # a task owns one core: NumPy in a worker must not start a thread for every core of the machine
    sc.environment.setdefault("OMP_NUM_THREADS", "1")
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tastemap-pkg-"), "tastemap.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("tastemap", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
