from __future__ import annotations

import pytest

from taskledger.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples in the given column order."""

    def collect(df, *columns):
        found = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
        return sorted(found, key=lambda r: [(v is None, str(type(v)) if v is None else "", v) if v is not None else (True, "", 0) for v in r])

    return collect
