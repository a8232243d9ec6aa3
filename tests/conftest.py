import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("LODEWRIGHT_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from lodewright.session import local_session, ship

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(session)
    return session


@pytest.fixture(scope="session")
def tiny():
    if not (DATA / "sf0.001").exists():
        pytest.skip("test tables are not there")
    return str(DATA / "sf0.001")
