import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from clonoframe.session import local_session

    s = local_session(cores="4", shuffle_partitions=4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
