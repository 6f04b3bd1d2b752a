import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression of `x` for each given text."""
    from pyspark.sql import functions as F

    def run(make, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        got = [r.v for r in rows.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]
        return got[0] if len(got) == 1 else got

    return run
