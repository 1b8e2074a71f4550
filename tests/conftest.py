import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vulntide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vulntide-tests-")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a SQL expression over named text inputs."""

    def run(expression, **inputs):
        names = ", ".join(f"{name} string" for name in inputs) or "unused string"
        row = tuple(inputs.values()) or ("",)
        return spark.createDataFrame([row], names).selectExpr(f"{expression} AS x").first()[0]

    return run
