import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts or (id, text) pairs."""

    def build(*rows, extra=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
        for name in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return build
