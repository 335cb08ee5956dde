import time

from pyspark.sql import functions as F

from placeloom.session import discard, materialize


def test_stored_stages_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    df, path = materialize(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count(), "tidy")
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and spark.conf.get(key) == setting
    assert df.count() == 1000
    discard(spark, path)
