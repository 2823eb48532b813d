import os
import pathlib
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import tapewright.llm  # noqa: E402
from odd_rows import ODD_ROWS  # noqa: E402
from tapewright.session import ship_package  # noqa: E402


def _names_of_operators():
    """Every column name that an operator spells out in an alias or a new column, and some shaped like its own."""
    folder = pathlib.Path(tapewright.llm.__file__).parent
    found = {n for p in folder.glob("*.py") for n in re.findall(r"(?:alias|withColumn|withColumnRenamed)\(\s*f?\"(\w+)\"", p.read_text())}
    found |= set(re.findall(r"\"(\w+)\", F\.", " ".join(p.read_text() for p in folder.glob("*.py"))))
    more = "source block shard words key fp a b root node seed place start score label digest row n_chars _id _kept_id _kept_key _leak_id _leak_key _row kept leak whole".split()
    return sorted((found | set(more)) - {"doc_id", "text", "lang"})


NAMES = _names_of_operators()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text[, lang]) as documents in one file, with columns that share names with the operators' own."""

    def build(rows, tmp_path):
        rows = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        for name in NAMES:
            df = df.withColumn(name, F.lit("clash"))
        path = str(tmp_path / "docs")
        df.coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return build


@pytest.fixture
def odd_docs(docs_of, tmp_path):
    return docs_of(ODD_ROWS, tmp_path)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, block string")
