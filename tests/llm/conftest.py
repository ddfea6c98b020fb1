import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from texts or (doc_id, text) pairs, in two partitions."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (n, t) for n, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], SCHEMA).repartition(2)

    return make


@pytest.fixture(scope="session")
def clashing():
    """A frame with more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    names = ["rid", "gid", "row", "kept", "head", "run", "level", "node", "set_key", "prefix", "_row", "_text", "found", "unit", "position", "bucket", "rank", "block", "new", "_id", "_key", "digest", "kind"]
    return lambda df: df.withColumns({c: F.lit("x") for c in names})
