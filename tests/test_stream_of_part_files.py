from staylens.streaming import jobs


def test_a_directory_of_part_files_streams_whole(spark, tmp_path):
    spark.range(0, 10, 1, 3).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    q = jobs.items(spark, str(tmp_path)).writeStream.format("memory").queryName("part_files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("part_files").count() == spark.read.parquet(f"{tmp_path}/events.parquet").count() == 10
