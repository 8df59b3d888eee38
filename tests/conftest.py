import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from wattline.plans.session import prepare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def rows(df, digits=7):
    """Sorted rows with rounded numbers, columns in name order."""
    cols = sorted(df.columns)

    def norm(v):
        if v is None:
            return "NULL"
        return f"{v + 3e-9:.{digits}f}" if isinstance(v, float) else str(v)

    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
