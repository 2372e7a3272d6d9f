"""Word hashes do not depend on how the text is cut into stretches."""

import pytest

from logdistill.llm import wordhash

TEXTS = ["", "one", " \t a b\n\na  ", "é" * 9 + " x", "Long" * 50 + " tail", "\x0b", "a b a"]


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("stretch", [1, 2, 7, 1000])
def test_stretches(monkeypatch, stretch, lower):
    alone = [h for t in TEXTS for w in t.split() for h in wordhash.Words([w.encode()], lower).hash.tolist()]
    monkeypatch.setattr(wordhash, "STRETCH", stretch)
    words = wordhash.Words([t.encode() for t in TEXTS], lower)
    assert words.hash.tolist() == alone
    assert words.doc.tolist() == [i for i, t in enumerate(TEXTS) for _ in t.split()]
    spans = zip(words.start, words.end, strict=True)
    assert [words.buffer[a:b].decode() for a, b in spans] == [w for t in TEXTS for w in t.split()]


@pytest.mark.parametrize("texts", [[], [b""], [b" ", b""]])
def test_no_words(texts):
    words = wordhash.Words(texts)
    assert len(words.hash) == len(words.doc) == 0
