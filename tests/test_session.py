import time

from pyspark.sql import functions as F

from ratingkit.session import cut_lineage, forget, stored


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def _sums(spark):
    return spark.range(20_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))


def test_stored_and_cut_leave_no_shuffle_files(spark):
    frame = _sums(spark)
    for keep in (lambda df: stored(df, "sums"), cut_lineage):
        before = _shuffle_files(spark)
        out = keep(frame)                # frame is still referred to, so garbage collection would not help
        for _ in range(50):
            if not (left := _shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
        assert out.count() == 1000 and frame.count() == 1000


def test_forget_deletes_the_files(spark, tmp_path):
    out = stored(_sums(spark), "sums")
    path = out.inputFiles()[0].removeprefix("file://")
    forget(out)
    import os
    assert not os.path.exists(path)
