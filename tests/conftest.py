import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from doccluster.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(texts):
        return spark.createDataFrame(
            list(texts.items()), "doc_id bigint, text string"
        ).repartition(2)

    return build


@pytest.fixture(scope="session")
def cat_docs_of(spark):
    def build(rows):
        return spark.createDataFrame(rows, "cate string, doc_id bigint, text string")

    return build
