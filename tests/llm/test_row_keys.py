import corpus_pipeline
from staylens.llm import simhash

from .samples import PASSAGE, prose


def test_clean_rows_without_an_id_stay(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, PASSAGE), (None, prose(50, 1)), (4, PASSAGE + " more"), (4, prose(50, 2)), (5, prose(50, 3))]
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_texts_that_share_an_id_stay(spark):
    rows = [(1, prose(50, 1)), (1, prose(50, 2)), (1, prose(50, 2)), (None, prose(50, 3)), (None, prose(50, 4))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)
