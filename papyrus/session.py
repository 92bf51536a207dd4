"""Session helpers: a local builder for tests and benchmarks, and the
shared checkpoint folder used to cut lineage in iterative operators.

Library operators never build a session; they take DataFrames and use
``df.sparkSession``.  Only tests, ``bench.py`` and the entry point call
:func:`local_session`.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "papyrus") -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only when nothing is configured *and* the master is local
    (tests) a scratch folder is created.  On a cluster without the setting
    this raises instead of silently writing to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="papyrus-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        f"{CHECKPOINT_CONF} is not set; iterative operators need a shared "
        "folder (HDFS/S3/ABFS) to checkpoint into")


_BUCKETS = "papyrus-buckets-"


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


#: Open scratch scopes, innermost last; the first one ends with the process.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if _BUCKETS in path:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch
        return


def _drop(scope: list[tuple[SparkSession, str]]) -> None:
    while scope:
        _delete(*scope.pop())


atexit.register(lambda: [_drop(scope) for scope in _scopes])


@contextlib.contextmanager
def scratch():
    """Owner of the intermediate tables written inside the block: they are
    deleted when it ends, on success and on failure.  Results must be
    consumed (or saved) before that.  Tables written outside any block are
    deleted when the process ends."""
    scope: list[tuple[SparkSession, str]] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        _drop(scope)


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new folder name in the shared checkpoint folder, owned by the
    current :func:`scratch` block."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/papyrus-{kind}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


#: Spark removes the shuffle files of a query that has ended (else they stay
#: until the driver happens to collect its garbage).
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` is ``value`` for the queries run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def own_shuffles(spark: SparkSession):
    """Shuffles of the queries run inside go with the query: for writes, whose
    plan nobody runs again, so that disk holds one step of a job at a time."""
    return setting(spark, CLEANUP_CONF, "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and continue from a plain scan of it.

    The files survive executor loss, and the new plan starts empty: unlike
    ``Dataset.checkpoint``, a scan carries no constraints inherited from
    the plan that produced it, so iterative plans do not grow harder to
    optimise from step to step.  The table belongs to the current
    :func:`scratch` block; shuffles of the plan are deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with own_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Materialise ``df`` as a table bucketed and sorted by ``keys``, one file
    a bucket, in the shared checkpoint folder.

    A join on exactly ``keys`` reads it where it lies: only the other side is
    shuffled.  The table belongs to the current :func:`scratch` block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    with own_shuffles(spark):
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
         .format("parquet").option("path", path).saveAsTable(_table_name(path)))
    return spark.table(_table_name(path))


def release(df: DataFrame) -> None:
    """Delete the files behind a :func:`cut_lineage` result that no later
    plan reads any more (iterations drop superseded states this way)."""
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rsplit("/", 1)[0]
    name = folder.rsplit("/", 1)[1]
    if not name.startswith("papyrus-"):
        return
    _delete(df.sparkSession, folder)
    for scope in _scopes:
        scope[:] = [(s, p) for s, p in scope if not p.endswith(name)]
