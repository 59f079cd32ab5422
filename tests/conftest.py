import uuid

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.ivmspark.root", str(base / "tables")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def db(spark):
    """A database of its own: names, tables and what is in them."""
    return Db(spark)


class Db:
    def __init__(self, spark):
        self.spark, self.name = spark, f"t{uuid.uuid4().hex[:10]}"

    def __call__(self, table):
        return f"{self.name}.{table}"

    def make(self, table, rows, ddl="id int, v string", pk=None):
        from ivmspark import table as versioned

        t = versioned(self.spark, self(table))
        t.create(self.spark.createDataFrame(rows, ddl), pk=pk)
        return t

    def insert(self, table, rows):
        from ivmspark import table as versioned

        t = versioned(self.spark, self(table))
        t.insert(self.spark.createDataFrame(rows, t.schema()))

    def rows(self, table, *columns):
        from ivmspark import current

        df = current(self.spark, self(table))
        return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)

    def feed(self, table, key):
        """Keys in the change of the table's last commit."""
        from ivmspark import table as versioned

        t = versioned(self.spark, self(table))
        last = t.latest()
        return sorted({r[0] for r in t.changes_of([last.version]).zset.select(key).collect()}) if "" in last.streams else []
