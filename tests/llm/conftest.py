from __future__ import annotations

import pytest

from .corpus import corpus, frame


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def twice(docs):
    """Every row twice: equal ids, equal texts."""
    return docs.unionByName(docs)


@pytest.fixture
def table_of(tmp_path):
    """Writes a frame as the table ``documents`` of a new folder."""

    def write(df) -> str:
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write
