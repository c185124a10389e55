"""Samples and budgets when ids are null or one id holds many rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyseek.llm import language_id, mixing, secrets
from tallyseek.llm.common import bounded_sample
from tests.llm.fixtures import no_docs


def shared_ids(spark, rows):
    """Half without an id, half with one id; two languages that share no word."""
    return spark.range(rows, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "eins zwei drei vier").otherwise("one two three four").alias("text"),
        F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.lit("s").alias("source"), F.lit(18).cast("long").alias("n_chars"),
    )


def test_samples_are_bounded_and_never_empty(spark):
    docs = shared_ids(spark, 20_000)
    assert 2700 < bounded_sample(docs, "doc_id", 3000).count() < 3300
    per = {r.lang: r["count"] for r in bounded_sample(docs, "doc_id", 500, by="lang").groupBy("lang").count().collect()}
    assert all(400 < per[lang] < 600 for lang in ("de", "en"))
    assert bounded_sample(docs.limit(40), "doc_id", 500, by="lang").count() == 40
    assert bounded_sample(no_docs(spark), "doc_id", 5, by="lang").count() == 0


def test_every_value_is_sampled(spark):
    """More than 500 languages, and a null one that teaches nothing."""
    docs = spark.range(1300).select("id", F.when(F.col("id") < 1200, (F.col("id") % 600).cast("string")).alias("lang"), F.lit("x").alias("text"))
    found = bounded_sample(docs, "id", 2, by="lang")
    assert found.select("lang").distinct().count() == 600 and found.filter("lang IS NULL").count() == 0


def test_secret_dictionary_counts_every_document(spark):
    """Words of three documents each, among 12,000, are in the dictionary; those of two are not."""
    rare = F.concat(F.lit("word"), F.translate((F.col("id") % 40).cast("string"), "0123456789", "abcdefghij"))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 120, rare).when(F.col("id") < 122, "twice").otherwise("common").alias("text"))
    words = secrets.fit_context(docs).words
    assert len(words) == 41 and "common" in words and "twice" not in words


def test_language_stage_keeps_documents_with_shared_ids(spark):
    docs = shared_ids(spark, 20_000)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 20_000
    model = language_id.fit_backoff(docs)
    right = language_id.identify(docs, model, ["lang"]).filter("lang = lang_pred").count()
    assert right == 20_000


def test_mix_meets_its_target_with_shared_ids(spark):
    """One source of 1000 equal rows without ids takes its 1500 words; so do rows of mixed sizes and a hot id."""
    rows = [(None, "word", "s")] * 1000
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sum(r.taken for r in found) == 1500 and {r.taken for r in found} == {1, 2}
    mixed = [(1 if i % 3 else None, "w " * (i % 7), "ab"[i % 2]) for i in range(700)]
    found = mixing.mix_sources(spark.createDataFrame(mixed, "doc_id long, text string, source string")).collect()
    by_target = {}
    for r in found:
        assert r.taken <= 2 * r.size
        by_target[r.target] = by_target.get(r.target, 0) + r.taken
    assert all(int(target) == taken for target, taken in by_target.items())
