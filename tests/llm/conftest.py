import pytest


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text) rows, with columns whose names clash."""

    def make(rows, columns="doc_id long, text string"):
        frame = spark.createDataFrame(rows, columns)
        taken = ["score", "row", "shard", "component", "n", "lang", "found", "key", "spans", "base"]
        for name in taken:
            if name not in frame.columns:
                frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make
