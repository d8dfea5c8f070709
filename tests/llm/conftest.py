import pytest

from rivulet.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)
