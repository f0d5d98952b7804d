"""The caches of operator 1 hold few bytes an entry, and texts of marks and bytes come out as the library codes them."""

import sys

import pytest


@pytest.fixture(scope="module")
def coder():
    from dictaudit.llm.queries import tokenizer_path
    from dictaudit.llm.sentencepiece_bpe import Coder, Model

    return Coder(Model.load(tokenizer_path()))


def test_cache_entries_are_small(coder):
    coder.both(" ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(20)))
    held = [sys.getsizeof(k) + sys.getsizeof(v) + (sum(map(sys.getsizeof, v)) if isinstance(v, tuple) else 0) for k, v in coder.cache.items()]
    assert len(held) >= 8000
    assert sum(held) / len(held) < 130  # a key with space marks, ids and decoded text in a tuple: more than 240


def test_marks_and_bytes_as_the_library(coder):
    import sentencepiece
    from dictaudit.llm.queries import tokenizer_path

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for text in ["", " ", "▁", " ▁ a", "a▁b", "a  b\tc\nd\r\n", "\x01\x7f", "é日本語 漢字\n", "🙂 a🙂\n🙂", "▁▁x ▁", "1 2\x0b"]:
        ids, decoded = coder.both(text)
        assert ids.tolist() == lib.encode(text)
        assert decoded == lib.decode(lib.encode(text))
