"""Banks and items that no single task reads or makes for a whole probe."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tribunal.operators import probes
from tribunal.plans import derived


def tables(spark, langs):
    return spark.createDataFrame([(k, langs(k), f"text {k} " + "x" * (k % 7)) for k in range(300)], "doc_id long, lang string, text string")


@pytest.mark.parametrize("langs", [lambda k: "en", lambda k: ("en", "en", "de", "de", None, None)[k % 6]])
def test_a_bank_is_that_of_its_sql(spark, monkeypatch, langs):
    monkeypatch.setattr(derived, "BLOCK_BITS", 4)
    docs = tables(spark, langs)
    columns = ("probe", "bank_idx", "question", "biased", "neutral", "belief")
    got = derived.bank_entries(spark, "", documents=docs).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, derived.derived(spark, "", derived.BANK, documents=docs).select(*columns).collect())) and len(got) == 150


def test_a_language_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(derived, "BLOCK_BITS", 4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entries = derived.bank_entries(spark, "", documents=tables(spark, lambda k: "en"))
        assert entries.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 1
        one = probes.bank_frame(spark, ("position",), {"position": [{"question": "q", "biased": "b", "neutral": "n"}]}).drop("markers")
        monkeypatch.setattr(probes, "ROUNDS", 8)
        made = probes.generate_items(one, 1000).withColumn("task", F.spark_partition_id())
        assert made.groupBy("task").count().count() > 1 and sorted(r.item_no for r in made.select("item_no").collect()) == list(range(1000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_entries_without_a_probe_have_no_items(spark):
    entries = derived.bank_entries(spark, "", documents=tables(spark, lambda k: "en" if k % 4 < 2 else None))
    assert {(r.probe, r["count"]) for r in probes.generate_items(entries, 40).groupBy("probe").count().collect()} == {("en", 40)}
