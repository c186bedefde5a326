import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """documents from a list of texts or (doc_id, text) pairs."""
    def make(items, extra=False):
        rows = []
        for i, x in enumerate(items):
            d, t = x if isinstance(x, tuple) else (i, x)
            rows.append((d, t, "en", f"src{i % 3}", None if t is None else len(t)))
        df = spark.createDataFrame(rows, DOC_SCHEMA)
        if extra:  # columns whose names the operators use themselves
            df = df.selectExpr("*", "'x' AS row", "1 AS fp", "2 AS tag", "3 AS n_words", "'q' AS quality_stats",
                               "'k' AS key", "0 AS bucket", "'m' AS md5", "array(1) AS spans")
        return df
    return make


ODD = [(None, None), (3, ""), (3, "   \n "), (4, "one"), (4, "one"), (7, "x" * 5000), (8, None),
       (9, "é ü 😀 日本語\n\n tab\there  two  spaces "), (10, "a b c d e f g h i j k l m n o p " * 400)]
