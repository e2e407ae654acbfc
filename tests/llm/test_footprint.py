"""What staged tables leave on disk and near-duplicate search holds in memory."""

from brisa.llm import minhash
from brisa.llm.batches import stage
from made import documents
from pyspark.sql import functions as F

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {int(name.split("_")[1]) for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    got = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "footprint")
    assert not shuffles(spark) - before
    assert got.agg(F.sum("count")).first()[0] == 1000


def test_near_duplicates_take_small_batches(spark, monkeypatch):
    seen, work = [], minhash._near_duplicates

    def spy(docs, *args):
        seen.append(int(spark.conf.get(ROWS)))
        return work(docs, *args)

    monkeypatch.setattr(minhash, "_near_duplicates", spy)
    before = spark.conf.get(ROWS)
    out = minhash.near_duplicates(documents(spark, [(1, "a b c d e f", "en", "a"), (2, "a b c d e f", "en", "a"), (3, None, "en", "a")]))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert seen and max(seen) <= 1000 and spark.conf.get(ROWS) == before
