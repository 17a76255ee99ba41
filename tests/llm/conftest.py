import pytest

#: Columns that the operators use inside or add; a table may have them already.
CLASHES = ("n_lines", "_site", "line", "host", "n", "sid", "start", "key", "rid", "body", "kept", "ids", "_block", "code")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns that clash."""

    def make(rows, clash=True):
        rows = [(*r, *(None, "en", "a")[len(r) - 1 :]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("mine") for c in CLASHES})
        return df

    return make
