import os
import sys
import tempfile
import uuid

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def _run_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def folder(_run_dir):
    """A path that does not exist yet."""
    return f"{_run_dir}/{uuid.uuid4().hex}"


@pytest.fixture
def conf(spark):
    """Set session properties for one test."""
    before = {}

    def set_property(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_property
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
