import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).parents[1], Path(__file__).parent):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from llm_support import rows  # noqa: E402


@pytest.fixture(scope="session")
def documents():
    return rows("documents")
