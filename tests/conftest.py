import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tertulia.plans.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def on_texts(spark):
    """Apply a column function to literal texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
        found = {r.i: r.x for r in rows.select("i", function(F.col("t")).alias("x")).collect()}
        return [found[i] for i in range(len(texts))]

    return run


@pytest.fixture(scope="session")
def messages(spark):
    from tertulia.schema import MESSAGES

    def build(*rows):
        full = [("c", i + 1, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(full, MESSAGES)

    return build
