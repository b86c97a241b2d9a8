"""Files that executors need, through the folder that the cluster shares: this package's code, and lookup files."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import terrane


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a private one only in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file into the shared folder by Hadoop's file systems, unless one of that name is there; its path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{name}")
    fs = path.getFileSystem(conf)
    path = fs.makeQualified(path)
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.part-{os.getpid()}")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        fs.rename(part, path)
    return path.toString()


def _package() -> bytes:
    root = Path(terrane.__file__).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*")):
            if f.is_file() and "__pycache__" not in f.parts:
                z.writestr(zipfile.ZipInfo(str(Path("terrane") / f.relative_to(root))), f.read_bytes())
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_terrane_shipped", False):
        return
    data = _package()
    context.addPyFile(put_shared(spark, f"terrane-{hashlib.sha256(data).hexdigest()[:16]}.zip", data))
    context._terrane_shipped = True
