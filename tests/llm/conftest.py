import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as dictionaries under a schema."""
    return lambda schema, rows: spark.createDataFrame([tuple(r) for r in rows], schema)
