import os

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from quantafold.session import get_spark

    session = get_spark("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
