import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evidentia.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", "tests", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__executorEnv__PYTHONPATH=str(ROOT))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
