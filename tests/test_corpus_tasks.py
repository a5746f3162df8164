"""The text work on derived scripts is shared out by rows, not by the bytes of the keys."""

from checks import corpus as corpus_source
from checks.corpus import corpus
from checks.queries import _good, _stored_registry, inserted_registry, translated_registry


def part(spark, tmp_path, keys=700):
    rows = spark.range(keys).select("id").withColumnRenamed("id", "p_partkey").coalesce(1)
    rows.write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def rows_by_task(frame):
    return [n for n in frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_one_small_file_of_keys_is_many_tasks(spark, tmp_path, monkeypatch):
    folder = part(spark, tmp_path)
    least = spark.sparkContext.defaultParallelism
    assert len(rows_by_task(corpus(spark, folder))) == least > 1
    monkeypatch.setattr(corpus_source, "KEYS_PER_TASK", 50)
    found = rows_by_task(corpus(spark, folder))
    assert len(found) == 14 and max(found) <= 51 and sum(found) == 700


def test_insert_reads_replies_that_are_stored(spark, tmp_path):
    folder = part(spark, tmp_path)
    want = _good(spark, folder).select("sql_file_name", "md5").distinct().count()
    assert inserted_registry(spark, folder).count() == want > 0


def test_translations_of_a_spread_corpus(spark, tmp_path):
    folder = part(spark, tmp_path)
    done = translated_registry(spark, folder)
    assert done.count() == _stored_registry(spark, folder).count()
    assert done.where("target_sql is not null").count() > 0
