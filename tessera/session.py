from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; what the cluster sets is kept."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
