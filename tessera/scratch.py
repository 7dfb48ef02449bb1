"""Tables and files that a plan stores on its way, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where nothing is named and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python functions refer to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="tessera-")).resolve() / f"tessera-core-{sc.applicationId}.zip"
    with zipfile.ZipFile(file, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(file))


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    where, system = hadoop_path(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def store(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: several later plans share it, and it outlives executors."""
    path = f"{new_path(df.sparkSession, tag)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_stored = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``store`` that no later plan reads."""
    for table in tables:
        where, system = hadoop_path(table.sparkSession, table._tessera_stored)
        system.delete(where, True)


def write_file(spark: SparkSession, path: str, body: bytes) -> None:
    """One small file on any storage that Spark reads."""
    where, system = hadoop_path(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a small file; None where there is none."""
    where, system = hadoop_path(spark, path)
    if not system.exists(where):
        return None
    return b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).select("content").collect())
