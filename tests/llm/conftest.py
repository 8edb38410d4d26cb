from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factloom.llm.spread import ship  # noqa: E402
from factloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """A session whose Python workers can import the library."""
    return ship(local_session(8, shuffle_partitions=4))
