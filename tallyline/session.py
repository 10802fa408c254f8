"""Spark session used by the tests and the benchmark.

On a cluster the session comes from spark-submit; only the options that change
results or skew handling are set here, sizes belong to the deployment.
"""

from pyspark.sql import SparkSession


def build_session(app: str = "tallyline", cores: int = 8, shuffle_partitions: int | None = None,
                  memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
