"""What tasks keep of one another's work."""

from __future__ import annotations

import public_tokenizers
from tillcast.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_frequent_words_stay_remembered(monkeypatch):
    """A full memory loses the words that the texts at hand do not have, and no others."""
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(JSON)
    learnt = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda parts: (learnt.append(set(parts)), learn(parts)))
    texts = ["one two three four", "one two five", "one six\nseven", " two one"]
    for text in texts:
        (ids,) = encoder.encode([text])
        assert ids == encoder._ids(text).tobytes()
    assert learnt == [{"one", " two", " three", " four"}, {" five"}, {" six", "\nseven"}, {" one"}]


def test_one_tokenizer_a_worker():
    assert packing.remembered(JSON) is packing.remembered(JSON)
