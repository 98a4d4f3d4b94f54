import os
import sys
from pathlib import Path

import pytest

from tiffin.session import Stage

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session", autouse=True)
def workers_import_the_library(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture()
def stage(spark):
    with Stage(spark) as made:
        yield made


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, size string"


@pytest.fixture()
def rows():
    """Rows of documents with columns whose names clash with results of operators."""
    return lambda *texts: [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts, 1)]


@pytest.fixture()
def documents(spark):
    """A documents table from rows, in several partitions."""
    return lambda made, partitions=3: spark.createDataFrame(made, SCHEMA).repartition(partitions)
