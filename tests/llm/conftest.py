import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                        StructField("lang", StringType()), StructField("source", StringType()),
                        StructField("n_chars", LongType()),
                        # Names that operators use inside.
                        StructField("id", StringType()), StructField("n", StringType()),
                        StructField("size", StringType()), StructField("component", StringType())])
PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()),
                    StructField("html", StringType()), StructField("digest", StringType())])
VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())),
                      StructField("label", IntegerType()), StructField("id", StringType()),
                      StructField("v", StringType())])


@pytest.fixture
def documents(spark):
    def build(rows):
        """Rows of (doc_id, text[, lang[, source]])."""
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), "x", "y", "z", "w")
                                      for a, b, c, d in full], DOCUMENTS)
    return build


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, None, "clash", "clash") for i, v in rows], VECTORS)
