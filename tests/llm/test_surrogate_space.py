"""Surrogates of names where there are more names than short surrogates."""

from pyspark.sql import functions as F

from tidemark.llm import pii


def test_search_for_free_names_ends_however_few_syllables(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {script: tuple(part[:1] for part in parts) for script, parts in pii.SYLLABLES.items()})
    names = ["mr stone", "mr brook", "mr field", "mr marsh"]
    distinct = spark.createDataFrame([("name", n) for n in names], "kind string, canon string")
    again = pii.redrawn(distinct, "key")
    tries = distinct.join(again, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    given = [r[0] for r in tries.select(pii.surrogate("key", F.col("kind"), F.col("canon"), F.col("attempt"))).collect()]
    assert len(set(given)) == len(names) and not set(given) & set(names)
