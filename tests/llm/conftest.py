import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_cases import SF


@pytest.fixture(scope="session")
def sf():
    return SF
