import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + ":" + os.environ.get("PYTHONPATH", "")
DATA = Path(os.environ.get("FOLIOFORGE_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from folioforge.session import local_session

    s = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
