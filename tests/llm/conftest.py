import pytest

from carelens.session import scratch_path


@pytest.fixture()
def tables(spark, tmp_path):
    """Write small tables as <folder>/<name>.parquet and return the folder."""
    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


@pytest.fixture()
def folder(spark):
    return scratch_path(spark, "test")
