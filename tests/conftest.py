import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foliary.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture
def partitions(spark):
    """Run something at several shuffle widths and insist on one answer."""

    def check(build):
        answers = []
        before = spark.conf.get("spark.sql.shuffle.partitions")
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.catalog.clearCache()
            answers.append(sorted(map(tuple, build().collect()), key=repr))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert answers[0] == answers[1]
        return answers[0]

    return check
