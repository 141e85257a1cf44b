import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chatloom.session import get_session

    folder = tmp_path_factory.mktemp("spark")
    session = get_session(
        "tests", cpus="4", **{
            "spark.sql.shuffle.partitions": "5", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(folder / "checkpoint"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    yield session
    session.stop()


MESSAGES = "id bigint, chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string"


@pytest.fixture
def messages_of(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, MESSAGES + extra)

    return make
