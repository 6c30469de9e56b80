"""Items of few shingles inside long documents."""

import pyarrow as pa
import pytest

from millrace.llm.containment import Index


@pytest.mark.parametrize("words", [5, 6, 8])
def test_containment_finds_every_short_item(words):
    """600 items of one, two and four shingles, each at the start of its own document."""
    items = [" ".join(f"a{i}x{j}" for j in range(words)) for i in range(600)]
    texts = [" ".join([item, *(f"b{i}x{j}" for j in range(60))]) for i, item in enumerate(items)]
    found = list(Index(list(range(600)), items).search(pa.array(texts)))
    assert found == [(i, i, words - 4, words - 4) for i in range(600)]
