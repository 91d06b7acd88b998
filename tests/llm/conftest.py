import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must take: null, empty, blank, very long, copies, control strings, signs."""
    return [None, "", " \n\t ", "one", "One two three four", "a\x0bb\x0cc\x1cd\xa0e f\x85g", "word " * 9000, "x" * 5000, "<|endoftext|> it's <|startoftext|>we'll!! 漢字 ΣΑΣ é é", "same text here again and again", "same text here again and again", "A1b2, 3.5% (ok) \U0001f600"]
