"""Ends of a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later jobs read what was written, also after an executor is lost. The folder is spark.checkpoint.dir; where that is unset, one below
    the warehouse, or a temporary one in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        local = sc.master.startswith("local[") or sc.master == "local"
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or (tempfile.mkdtemp(prefix="spark-") if local else f"{warehouse}/_checkpoints"))
    return df.checkpoint(eager=True)
