import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session(4, 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
