import pytest

pytest.importorskip("taxaloom.llm.queries")
