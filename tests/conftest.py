import pytest

from casemill.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "casemill-tests",
        master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.autoBroadcastJoinThreshold": "10MB",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
