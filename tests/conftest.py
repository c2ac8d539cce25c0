import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

from varve import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    spark = session.build(
        "tests", master="local[8]",
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.driver.extraJavaOptions": f"-Dderby.system.home={warehouse}",
            "spark.sql.maxMetadataStringLength": "5000",
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "2",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def duck(small):
    from tests import oracle

    return oracle.connect(small)
