import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tablelens.session import get_session

    s = get_session("local[4]", 4, app_name="tablelens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tmpdir_local(tmp_path):
    return str(tmp_path)
