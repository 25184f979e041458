import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from duelmark.session import configure

    shared = str(tmp_path_factory.mktemp("shared"))
    session = (SparkSession.builder.master("local[4]").appName("duelmark-tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.checkpoint.dir", shared).config("spark.log.level", "ERROR").getOrCreate())
    yield configure(session)
    session.stop()
