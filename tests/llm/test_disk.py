"""What the operators leave on disk between their steps."""

from __future__ import annotations

from orderflow import storage
from orderflow.llm import substring_dedup
from orderflow.staging import shared_folder, staged, staged_last
from test_text_operators import documents, prose


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_only_the_last_step_stays_on_disk(spark):
    docs = documents(spark, [(i, prose(80, 1 + i % 7) + " " + prose(60, i % 3), "en", "a") for i in range(30)])
    folder = shared_folder(spark)
    staged_before, shuffled_before = set(storage.names(spark, folder)), shuffle_files(spark)
    found = substring_dedup.repeated_places(docs)
    assert len(set(storage.names(spark, folder)) - staged_before) == 1  # five tables stayed before
    assert not shuffle_files(spark) - shuffled_before
    assert found.count() == 30


def test_a_failing_step_leaves_nothing(spark):
    folder, conf = shared_folder(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = set(storage.names(spark, folder)), spark.conf.get(conf, None)

    def steps():
        staged(spark.range(3))
        raise ValueError("broken")

    try:
        staged_last(spark, steps)
    except ValueError:
        pass
    assert set(storage.names(spark, folder)) == before
    assert spark.conf.get(conf, None) == setting
