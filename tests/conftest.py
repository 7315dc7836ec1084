import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")  # small matrices: more threads only wait for each other
ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from papyrion.runtime import local_session

    session = local_session(4, spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")), spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
