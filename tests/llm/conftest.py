import pytest
from llm_samples import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, nulls, repeated rows, and an extra column whose name clashes by case."""
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a", "y"), (3, "a", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
