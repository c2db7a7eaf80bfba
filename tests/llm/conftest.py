import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("llm-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, ties, repeated rows, empty and long texts, and a further column of a clashing name."""
    from .samples import DOCS

    return spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, lang string, fp string")
