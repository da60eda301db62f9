"""Session settings shared by the library, the tests and the benchmark.

The library never creates a session on its own inside an operator: every
operator takes an existing ``SparkSession`` (or a DataFrame) so that a cluster
deployment keeps full control of its configuration.  ``get_session`` is a
convenience for tests, the benchmark and local use.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for correct results.
#  * UTC session time zone: ``timestamp_ntz`` columns truncated with
#    ``date_trunc`` become session-zone timestamps; UTC keeps calendar
#    arithmetic identical on every executor and in the SQL oracle.
#  * AQE on: coalesces small shuffle partitions, splits skewed ones and
#    re-plans joins from runtime sizes.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tablelens",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the library's required settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.sql.execution.arrow.pyspark.enabled", "true")
    # no per-call origin capture when building wide expression lists
    conf.setdefault("spark.python.sql.dataFrameDebugging.enabled", "false")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_required_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the library's results depend on."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    # Rows go to Python workers in batches of bounded bytes: 10 000 long texts
    # at once are held several times over, by the JVM and by the worker.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    # Building wide expression lists is cheaper without per-call origin
    # capture; harmless if the setting is fixed in this session.
    try:
        spark.conf.set("spark.python.sql.dataFrameDebugging.enabled", "false")
    except Exception:  # noqa: BLE001
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder; it is read from the session and never replaced.  Only when it is
    unset (tests, a laptop) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder below the checkpoint root for small materialised tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), "tablelens", name)


def materialize(df: DataFrame) -> DataFrame:
    """Write a (small) frame as a table below the checkpoint root and read it back.

    One job computes and writes the frame; the returned DataFrame reads the
    written files, so its lineage is cut and it survives the loss of
    executors.  ``DataFrame.checkpoint(eager=True)`` would compute the plan
    twice (once to count, once to write), which this avoids.

    The table stays until an enclosing ``tidied`` function or ``sweep`` removes
    it; what neither removes can go with the folder ``tablelens`` below the
    checkpoint root once no result that reads it is wanted any more.
    """
    path = shared_dir(df.sparkSession, f"mat-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    open_scopes = _scopes()
    if open_scopes:
        open_scopes[-1].append(path)
    return df.sparkSession.read.parquet(path)


_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def _tables_read(frames) -> set[str]:
    """Names of the written tables that the frames' plans read."""
    return {m[0] for df in frames for f in df.inputFiles() for m in [re.search(r"mat-[0-9a-f]{32}", f)] if m}


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders on whatever file system they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(conf).delete(target, True)


def tidied(fn, left: list[str] | None = None):
    """A function that returns a DataFrame and removes, when it returns, the
    tables it wrote on the way and that the result does not read.  The others
    are left to an enclosing ``tidied`` function, or listed in ``left`` for a
    later ``sweep``.  The result must not read a written table inside a scalar
    subquery alone."""
    @functools.wraps(fn)
    def run(*args, **kwargs):
        scopes = _scopes()
        scopes.append([])
        try:
            out = fn(*args, **kwargs)
        finally:
            written = scopes.pop()
        used = _tables_read([out]) if written else set()
        kept = [p for p in written if os.path.basename(p) in used]
        if scopes:
            scopes[-1].extend(kept)
        elif left is not None:
            left.extend(kept)
        remove_paths(out.sparkSession, [p for p in written if p not in kept])
        return out

    return run


def sweep(spark: SparkSession, left: list[str], *wanted: DataFrame) -> None:
    """Remove the tables listed in ``left`` that ``wanted`` do not read: for a
    caller that has written every other result elsewhere."""
    used = _tables_read(wanted) if left else set()
    gone = [p for p in left if os.path.basename(p) not in used]
    remove_paths(spark, gone)
    left[:] = [p for p in left if p not in gone]


def local_path(path: str) -> str:
    """A POSIX path for Python-side file I/O (workbooks, SQLite files).

    ``file:`` URIs are unwrapped; other schemes (hdfs://, s3://) cannot be
    opened by the standard library, so such readers need a folder mounted on
    every executor.
    """
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        raise ValueError(f"needs a mounted POSIX path, got {path}")
    return path


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A small driver-side table as a JVM ``LocalRelation``.

    ``createDataFrame`` on a Python list builds a Python RDD, whose every use
    starts Python workers; going through pandas and Arrow gives a local
    relation that lives in the plan itself.  Meant for frames bounded by the
    schema (one row per column, levels, parameters), never for data.
    """
    import pandas as pd

    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    names = [f.name for f in schema.fields]
    data = [tuple(r) for r in rows]
    pdf = pd.DataFrame(data, columns=names, dtype=object) if data else pd.DataFrame(
        {n: pd.Series([], dtype=object) for n in names})
    if spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false").lower() != "true":
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark.createDataFrame(pdf, schema)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablelens`` importable in Python workers (once per application).

    Python data sources and ``mapInPandas`` functions are pickled by
    reference, so executors must import the package; it is zipped on the
    driver and distributed with ``addPyFile``.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="tablelens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(key)
