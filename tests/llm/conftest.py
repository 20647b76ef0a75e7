import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with further columns whose names operators use themselves."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
        if extra:
            for name in ("n", "key", "lines", "shard", "score", "bits", "digest", "keep_id", "length", "number", "lang_pred", "n_lines", "row", "host"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
