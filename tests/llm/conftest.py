import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


#: Nulls, blanks, repeats, ties, and extra columns whose names an operator might use itself.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "x", 1),
    (1, "alpha beta gamma delta epsilon zeta", "x", 1),
    (None, "alpha beta gamma delta epsilon zeta", None, 2),
    (2, None, None, None),
    (3, "", "y", 3),
    (4, "   \n\t ", "y", 3),
    (5, "one", "z", 4),
    (None, None, None, None),
    (6, "ünïcödé 漢字   x " * 30, "z", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_chars long").selectExpr(
        "doc_id", "text", "lang", "n_chars", "lang as source", "n_chars as id", "lang as digest", "n_chars as `a.b`", "lang as hits", "n_chars as c0", "'x' as TEXT", "lang as th"
    )
