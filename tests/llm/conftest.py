import pytest

from tests.llm import data


@pytest.fixture(scope="session")
def docs(spark):
    return data.awkward(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return data.nothing(spark)
