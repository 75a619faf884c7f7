import os
import sys

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tiermill.session import local

    session = local(8, shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bronze(spark):
    from tiermill.sources.bridge import Bronze

    return Bronze(spark, SMALL)
