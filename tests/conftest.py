import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rosterline.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
