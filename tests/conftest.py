import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from workload.check import session

    session_ = session(4)
    yield session_
    session_.stop()


@pytest.fixture(scope="module", autouse=True)
def _by_value(request):
    """Stand-in models of a test module travel to the Python workers by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(request.module)
    yield
    cloudpickle.unregister_pickle_by_value(request.module)
