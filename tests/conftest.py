import pytest

from caseweave.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield spark


@pytest.fixture
def small_tasks(spark):
    """Force the plans that split a hot group."""
    spark.conf.set("caseweave.rowsPerTask", "20")
    yield spark
    spark.conf.unset("caseweave.rowsPerTask")
