"""Published tables are whole or absent."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lemmaweave import storage


def test_publish(spark, tmp_path, monkeypatch):
    df = spark.range(100).select("id", F.array("id").alias("xs"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    to = f"{tmp_path}/table"
    assert storage.publish(df, to)[0] == 100 and storage.fingerprint(spark.read.parquet(to)) == storage.fingerprint(df.repartition(7))
    with pytest.raises(FileExistsError):
        storage.publish(df, to)
    # A task that fails, and files that are not what was meant, leave nothing.
    faulty = df.withColumn("s", F.when(F.col("id") == 50, F.raise_error(F.lit("bad entry"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="bad entry"):
        storage.publish(faulty, f"{tmp_path}/faulty")
    prints = iter([(99, 1), (100, 2)])
    monkeypatch.setattr(storage, "fingerprint", lambda _: next(prints))
    with pytest.raises(OSError, match="was written for"):
        storage.publish(df, f"{tmp_path}/short")
    assert [p.name for p in Path(tmp_path).iterdir()] == ["table"]


def test_two_publishers(spark, tmp_path, monkeypatch):
    """Of two that start together one wins, and the other's files are gone."""
    to, first = f"{tmp_path}/table", storage.fingerprint

    def other_is_first(df):  # while this one compares, the other publishes
        monkeypatch.setattr(storage, "fingerprint", first)
        storage.publish(spark.range(3), to)
        return first(df)

    monkeypatch.setattr(storage, "fingerprint", other_is_first)
    with pytest.raises(FileExistsError):
        storage.publish(spark.range(50), to)
    assert spark.read.parquet(to).count() == 3 and [p.name for p in Path(tmp_path).iterdir()] == ["table"]


def test_shipped_package(tmp_path):
    """Workers that start elsewhere, without PYTHONPATH, find the package after ship()."""
    import os
    import subprocess
    import sys

    root = Path(storage.__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from lemmaweave.storage import ship
from lemmaweave.functions.tokens import nfc
print(ship(spark).endswith(".zip"))
def run(batches):
    import lemmaweave.operators.classes as c
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.__file__] * b.num_rows)], names=["at"])
print({{".zip" in r.at for r in spark.range(3).mapInArrow(run, "at string").collect()}})
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert done.stdout.split("\n")[-3:] == ["True", "{True}", ""], done.stderr[-2000:]
