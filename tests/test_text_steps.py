import unicodedata

import pytest
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators import reference
from staylens.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def test_marked_letters_in_long_texts_and_at_their_start(spark):
    told = ["́é", "ếx" * 3, "a" * 5000 + "é" + "b" * 5000, "ﬁ" * 3000 + "²m", "", "\ǹ\nộ"]
    df = spark.createDataFrame(list(enumerate(told)), "i int, t string")
    got = {r.i: (r.c, r.p) for r in df.select("i", text.composed("t").alias("c"), text.strip_accents("t").alias("p")).collect()}
    assert [got[i][0] for i in range(3)] == [unicodedata.normalize("NFC", t) for t in told[:3]]
    assert got[3][1] == "fi" * 3000 + "2m" and got[2][1] == "a" * 5000 + "e" + "b" * 5000 and got[4] == ("", "")


def test_a_city_takes_its_words_once(spark):
    df = spark.createDataFrame([("5 Hà Nội", None)], "a string, m string").select(text.canonical_city("a", "m").alias("city"))
    assert df.first().city == "Hà Nội"
    assert df._jdf.queryExecution().analyzed().toString().count("translate(") <= 2


@pytest.mark.parametrize("name", ["room_conditions_of_lines", "canonical_room_names", "canonical_city_of_addresses"])
def test_a_small_file_is_dealt_over_the_cores(spark, name):
    out = registry.QUERIES[name](spark, SF)
    assert out.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism


def test_characters_that_stand_for_more_are_told_by_few_ranges(spark):
    """A class is tried part by part for each character of a text, so it has a part a range, not one a character."""
    assert len(text._ANY_MORE) < len(text._MORE)
    every = "".join(c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000)
    got = spark.createDataFrame([(every,)], "t string").select(F.regexp_extract_all("t", F.lit(text._ANY_MORE), 0).alias("c")).first().c
    assert set(got) == set(text._MORE)


def test_a_match_works_out_its_score_once(spark):
    names = ["room_key", "rate_key", "room_name", "room_area"]
    told = [f"'x' as {p}{c}" for p in ("", "ref_") for c in names] + ["2 as max_occupancy", "2 as ref_max_occupancy"]
    df = spark.range(1).selectExpr(*told).withColumn("ref_room_key", F.lit("y")).select(reference.match_score().alias("m"))
    assert df.first().m.asDict() == {"match": "alias", "score": 1.0}
    assert df._jdf.queryExecution().analyzed().toString().count("array_intersect(") == 1
