import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    return session("local[4]", 4, **{"spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
