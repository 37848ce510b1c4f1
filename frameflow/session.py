"""Session helpers: the shared folder, materialised steps and release of their shuffle files."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[weakref.ref, str]] = {}


def get_session(app: str = "frameflow", cores: int | str = "*") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _delete(spark_ref: weakref.ref, path: str) -> None:
    spark = spark_ref()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster's own clean-up takes over
        pass


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, which all executors reach.

    Only where that setting is unset (local tests) a temporary folder is made and set.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="frameflow-")
            spark.sparkContext.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/frameflow-{app}-{uuid.uuid4().hex[:8]}"
        _ROOTS[app] = (weakref.ref(spark), root)
        atexit.register(_delete, weakref.ref(spark), root)
    return _ROOTS[app][1]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session, unless PYTHONPATH (which they inherit) already has it."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    inherited = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or str(package.parent) in inherited:
        return
    _SHIPPED.add(app)
    path = Path(tempfile.mkdtemp(prefix="frameflow-")) / "frameflow_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frameflow_path = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete materialised steps that nothing reads any more, and those that a step is made of."""
    for df in steps:
        discard(*getattr(df, "_frameflow_steps", ()))
        path = getattr(df, "_frameflow_path", None)
        if path:
            _delete(weakref.ref(df.sparkSession), path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text into a file of any Hadoop scheme, whole or not at all; an existing file is replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of such a file, or None."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder of any Hadoop scheme; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    _delete(weakref.ref(spark), path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which otherwise waits for a full driver GC."""
    gc.collect()
    spark._jvm.System.gc()


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Enough partitions for a bound of rows in each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))
