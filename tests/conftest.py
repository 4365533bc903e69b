import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from factloom.plans.session import session, ship

    s = session("tests", "4", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    ship(s)
    yield s
    s.stop()
