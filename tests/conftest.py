import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of a column function over some texts."""
    from pyspark.sql import functions as F

    def run(step, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
        return [r[0] for r in rows.select(step(F.col("t")), "i").orderBy("i").collect()]

    return run
