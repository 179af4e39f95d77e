"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", master: str | None = None, **settings: str) -> SparkSession:
    """A session: a local one of ``cpus`` cores, or one of the cluster that ``master`` names, which sets its own number of partitions."""
    conf = ({} if master else {"spark.sql.shuffle.partitions": "8"}) | {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | settings
    return SparkSession.builder.master(master or f"local[{cpus}]").appName("custodia").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named by ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own; on a cluster a machine-local folder would lose data, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="custodia-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as files in the shared folder, where a lost executor cannot take it along."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = shared_folder(spark)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
