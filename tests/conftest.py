import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from floatline.session import get_spark
    s = get_spark("local[*]", app="floatline-tests", shuffle_partitions=8)
    yield s
    s.stop()


def one_column(spark, texts, fn, out="v"):
    """Apply a Column function to a list of texts; values in input order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[out] for r in df.select("i", fn(F.col("text")).alias(out)).orderBy("i").collect()]
