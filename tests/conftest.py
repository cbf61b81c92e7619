import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievelight.session import session

    s = session(4, 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("w")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("c")), "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
