import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gtspark.session import get_session

    s = get_session("local[4]", 4, app_name="gtspark-tests", conf={"spark.driver.memory": "4g"})
    yield s
