"""Session settings that results depend on (UTC, ANSI) and those that suit a local run."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", local_dir: str | None = None) -> SparkSession:
    """A local session; on a cluster the session is given and only ``spark.sql.session.timeZone`` must be UTC."""
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if local_dir:
        conf["spark.local.dir"] = local_dir
    spark = SparkSession.builder.master(f"local[{cores}]").appName("arenaflow").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
