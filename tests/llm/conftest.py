import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents_of(spark):
    """Builds a table of documents from texts, or from (id, text) pairs."""

    def build(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def sample_documents(spark):
    """Every document of the smallest tables as (id, text)."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"]) for r in rows)
