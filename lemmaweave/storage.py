"""Shared storage and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary folder serves
    a session in local mode; on a cluster it would be another folder on each machine, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lemmaweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: a lineage cut that survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lw_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Removes the files behind a cut that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "lw_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-independent sum of row digests."""
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, int(total)


def publish(df: DataFrame, to: str, form: str = "parquet") -> tuple[int, int]:
    """df under a path that nothing uses yet: all of it or nothing.

    It is written beside the path, read back and compared with what was to be written, and then renamed in one step of the file system, which fails if
    somebody else was first. Whatever fails, nothing is left. Returns the fingerprint. df is computed once for the files and once for the comparison."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(to)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"{to} already exists")
    stage = hadoop.Path(f"{to.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        df.write.format(form).mode("errorifexists").save(stage.toString())
        found, meant = fingerprint(spark.read.format(form).schema(df.schema).load(stage.toString())), fingerprint(df)
        if found != meant:
            raise OSError(f"{to}: {found} was written for {meant}")
        files = hadoop.FileContext.getFileContext(fs.makeQualified(stage).toUri(), spark._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(stage), fs.makeQualified(target), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as e:
        if fs.exists(target) and "AlreadyExists" in str(e):
            raise FileExistsError(f"{to} already exists") from e
        raise
    finally:
        fs.delete(stage, True)
    return found


def ship(spark: SparkSession) -> str:
    """Sends this package to the workers of a session that does not have it installed, as a zip file in the shared folder; its path is returned."""
    import io
    import zipfile
    from pathlib import Path

    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/lemmaweave-{uuid.uuid4().hex}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    return path
