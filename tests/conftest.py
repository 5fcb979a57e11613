import numpy as np
import pytest

from tomolake.config import reset_config
from tomolake.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[*]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__driver__host="127.0.0.1", spark__sql__execution__arrow__maxRecordsPerBatch="1000",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def plain_config():
    reset_config()
    yield
    reset_config()


@pytest.fixture
def make():
    def volume(shape=(6, 5, 4), dtype="float32", seed=0):
        rng = np.random.default_rng(seed)
        return (rng.random(shape) * 200 - 50).astype(dtype) if np.dtype(dtype).kind != "u" else rng.integers(0, 200, shape).astype(dtype)

    return volume
