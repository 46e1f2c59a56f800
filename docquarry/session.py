"""Session helpers: where shared intermediate data goes and how wide a scan runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster the
    folder must be reachable by every executor, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="docquarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _application_folder(spark: SparkSession) -> str:
    return "/".join((checkpoint_root(spark).rstrip("/"), "docquarry", spark.sparkContext.applicationId))


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, under this application."""
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two branches of a plan must see the very same rows (sampled range
    bounds, model output). The written files outlive lost executors. They stay until
    :func:`release` is called.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder on any file system Spark can reach, such as a stream checkpoint to be reset."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def committed_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders ``batch=n`` that a finished write has left in ``folder``, in order."""
    paths = spark._jvm.org.apache.hadoop.fs
    root = paths.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [entry.getPath() for entry in files.listStatus(root)]
    return sorted(int(p.getName().removeprefix("batch=")) for p in found
                  if p.getName().startswith("batch=") and files.exists(paths.Path(p, "_SUCCESS")))


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames built on it end there."""
    remove_folder(spark, _application_folder(spark))


@contextmanager
def arrow_batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for actions inside the block, for very large documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than there are cores.

    A small file of one row group would otherwise put all Python or regex work into a
    single task. A scan with enough partitions passes through unshuffled, whatever its size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_partitions(df) < cores else df


def scan_partitions(df: DataFrame) -> int:
    """Number of tasks in which ``df`` would be computed."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers; once per Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docquarry-")) / "docquarry.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
