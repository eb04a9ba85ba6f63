"""Cutting lineage in a folder that every executor sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the cluster's own, named by ``spark.checkpoint.dir``.

    Only in local mode, where one machine does all the work, a folder of our own will do where none is named; it is
    removed at the end of the process. On a cluster a missing setting is an error, as no folder of one machine serves.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    forget: drop the planner's estimates as well. A checkpointed table keeps the estimated size of the plan it came
    from, and a join's is the product of its sides', so a loop of joins over its own results makes numbers whose
    digits double each round, until planning takes longer than the work.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if not forget:
        return out
    rows = out._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)
