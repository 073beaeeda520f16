import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as a table of documents."""

    def make(rows):
        full = [(*row, *([None] * (4 - len(row)))) for row in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS).repartition(3)

    return make


@pytest.fixture
def written(spark, tmp_path):
    """A folder of tables as the queries read them."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
