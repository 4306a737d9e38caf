import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, f"{ROOT}/tests", f"{ROOT}/tests/llm", os.environ.get("PYTHONPATH", "")) if x)

import pytest  # noqa: E402

from lorevane.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config(
        "spark.ui.showConsoleProgress", "false").getOrCreate().sparkContext.setLogLevel("ERROR")
    s = session("tests")
    yield s
    s.stop()
