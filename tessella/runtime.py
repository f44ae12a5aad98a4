"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application.

    Python workers import operator functions by name. The zip goes through
    Spark's own file server, so no folder has to be shared.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessella-")), "tessella_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, Path("tessella") / f.relative_to(_PACKAGE))
    sc.addPyFile(target)
    sc._tessella_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is unset and the whole application runs in one
    process (``local`` masters, as in tests) is a folder chosen here; a cluster
    without the setting is an error, since a machine's own folder is lost with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared checkpoint folder and read it back.

    Columnar files take less room than checkpoint() does and keep column
    pruning; they go when the application ends.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    target = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    df.write.parquet(target)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
