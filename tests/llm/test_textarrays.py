import numpy as np

from graphloom.llm import textarrays as ta


def test_hashes_do_not_depend_on_the_pieces(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    data[r.integers(0, 5000, 900)] = 32
    data[1000:1300] = data[3000:3300] = 97  # a string longer than the pieces below
    start, end, _ = ta.words(data, np.array([0, 2000, 5000]))
    whole, three = ta.word_hashes(data, start, end), ta.grams(ta.byte_symbols(data), 7)
    ids = ta.exact_ids(data, start, end)
    text = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    same = lambda keys: [[x == y for y in keys] for x in keys]
    assert same(whole.tolist()) == same(text) == same(ids.tolist())
    monkeypatch.setattr(ta, "SLICE", 128)
    assert same(ta.word_hashes(data, start, end).tolist()) == same(text) == same(ta.exact_ids(data, start, end).tolist())
    assert (ta.grams(ta.byte_symbols(data), 7) == three).all()
    assert len(ta.grams(ta.byte_symbols(data[:3]), 7)) == 0 and len(ta.word_hashes(data, start[:0], end[:0])) == 0
