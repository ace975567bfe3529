import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").appName("llm-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Null, empty and blank texts, ties, repeated rows, a null id, a very long word and clashing column names.
EDGE_ROWS = [
    (1, None, "a", 1), (2, "", None, 2), (3, " \t\n ", "a", 3), (4, "one two three", "b", 4), (5, "one two three", "b", 5), (5, "one two three", "b", 5),
    (6, "x" * 60000, "b", 6), (7, "word " * 9000, None, 7), (None, "no id here at all", "c", 8), (8, "\x01 tel +1 (706) 555-3138 \x01 a@b.co", "c", 9),
]
EDGE_SCHEMA = "doc_id long, text string, source string, size long"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
