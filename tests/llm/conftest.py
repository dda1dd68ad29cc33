from __future__ import annotations

import pytest


@pytest.fixture
def write(spark, tmp_path):
    """Writes small tables as parquet and gives the folder that queries take."""

    def run(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return run
