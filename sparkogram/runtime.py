"""Session helpers: table loading, shared scratch space and lineage cuts.

Everything that has to outlive a stage is written below the folder the cluster
names in ``spark.checkpoint.dir``; executors and driver share nothing else.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package: sent along unless their path has it already."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, sc = os.path.dirname(package), spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or root in map(os.path.abspath, filter(None, paths)):
        return
    folder = tempfile.mkdtemp(prefix="sparkogram-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/sparkogram.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", root))
    sc.addPyFile(f"{folder}/sparkogram.zip")
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet table ``name`` of a data folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a plain ``local[...]`` session without that setting gets a temporary
    folder of its own (tests); a cluster without it is refused, because a
    machine-local folder would not be seen by other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_SCRATCH:
        path = tempfile.mkdtemp(prefix="sparkogram-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_SCRATCH.append(path)
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/sparkogram/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hpath)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    Later jobs start from the written table: a lost executor costs a re-read,
    not a recomputation, and iterative plans stay short.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` that is no longer needed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/sparkogram/" in f}
    for parent in parents:
        hpath = jvm.org.apache.hadoop.fs.Path(parent)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
