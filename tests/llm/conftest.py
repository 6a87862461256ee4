from __future__ import annotations

import itertools

import pytest

_number = itertools.count()


@pytest.fixture
def saved(spark, tmp_path_factory):
    """Rows as a table read from files, as operators that number rows need."""

    def make(rows, schema, parts=3):
        path = str(tmp_path_factory.mktemp("table") / str(next(_number)))
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
