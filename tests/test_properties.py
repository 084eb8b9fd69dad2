"""Property-based checks of the pure per-row helpers (no Spark needed)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from valora.operators import quality as QU
from valora.operators import text as TO

TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=3000)
SENTENCES = st.lists(st.text(alphabet="abcdefgh ,", min_size=1, max_size=120), max_size=60).map(
    lambda parts: ". ".join(parts))


@given(st.text(max_size=60))
def test_clean_name_idempotent_and_snake(name):
    c = QU.clean_name(name)
    assert QU.clean_name(c) == c
    assert re.fullmatch(r"[a-z0-9_]*", c)
    assert "__" not in c and not c.startswith("_") and not c.endswith("_")


@settings(max_examples=200)
@given(st.one_of(TEXT, SENTENCES))
def test_sentence_chunks_bounds(text):
    chunks = list(TO.sentence_chunks(text))
    assert all(50 < len(c) <= 500 for c in chunks)
    assert all(c == c.strip() for c in chunks)


@settings(max_examples=200)
@given(st.one_of(TEXT, SENTENCES), st.integers(20, 400))
def test_fixed_windows_cover_text(text, size):
    overlap = size // 5
    chunks = [text[lo:hi] for ((lo, hi),), _ in TO._windows(0, len(text), size, overlap)]
    if not text:
        assert chunks == []
        return
    assert chunks[0] == text[:size] and text.endswith(chunks[-1])
    assert all(len(c) <= size for c in chunks)
    # consecutive windows overlap by exactly ``overlap`` chars except the last join
    rebuilt = chunks[0] + "".join(c[overlap:] for c in chunks[1:])
    assert rebuilt == text


@settings(max_examples=100)
@given(SENTENCES, st.integers(60, 400))
def test_recursive_chunks_size_bound(text, size):
    chunks = TO.recursive_chunks(text, size, 0)
    assert all(len(c) <= size for c in chunks)
