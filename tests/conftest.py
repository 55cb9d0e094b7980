import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
# Python workers must import the package and the test modules (page functions).
os.environ["PYTHONPATH"] = os.pathsep.join(
    [REPO, os.path.join(REPO, "tests")] + ([os.environ["PYTHONPATH"]] if os.environ.get("PYTHONPATH") else [])
)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rollscan.session import checkpoint_dir, local_session

    s = local_session("*", 8)
    checkpoint_dir(s)
    yield s
    s.stop()
