import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or more; `extra` adds columns whose names the
    operators use inside."""

    def build(rows, extra=False):
        full = [(*r, *(None, None, None)[: 5 - len(r)])[:5] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "k", "h", "size", "sid", "pos", "node", "label", "unit", "rep", "block", "own", "a", "b", "x", "y", "ids", "component_id", "n_tokens", "bucket", "spans"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build
