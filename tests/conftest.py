import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def spark():
    from compare import spark_session

    session = spark_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
