import re

import numpy as np
import pyarrow as pa

from llm import textops as m
from llm.features import Chunk, chunks


def test_words_and_hashes_do_not_depend_on_place(monkeypatch):
    texts = ["a b\tc", None, "", " \n", "aé 𝄞b\x0bx", "b a c " * 50, "x" * 5000 + " y"]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict = {}
    for limit in (1 << 20, 7):
        for first, data, offsets in m.text_chunks(pa.array(texts), limit):
            starts, stops, of = m.words(data, offsets)
            hashes = m.word_hashes(data, starts, stops)
            for k in range(len(offsets) - 1):
                own = [data[a:b].tobytes().decode() for a, b in zip(starts[of[k] : of[k + 1]], stops[of[k] : of[k + 1]], strict=True)]
                assert own == want[first + k]
                for w, h in zip(own, hashes[of[k] : of[k + 1]].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_runs(monkeypatch):
    text = pa.array([" ".join(f"word{k % 700}" for k in range(4000))])
    (_, data, offsets), = m.text_chunks(text)
    starts, stops, _ = m.words(data, offsets)
    whole = m.word_hashes(data, starts, stops)
    features = next(chunks(text))[1].features()
    monkeypatch.setattr(m, "CHUNK_BYTES", 100)
    monkeypatch.setattr("llm.features.GRAM_BYTES", 333)
    assert (m.word_hashes(data, starts, stops) == whole).all()
    assert np.allclose(Chunk(data, offsets).features(), features)


def test_windows_depend_on_words_alone():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 5, 16, 50):
        both = m.windows(np.concatenate([h, h]), size)
        assert (both[: len(h) - size + 1] == both[len(h) :]).all() and len(np.unique(both[: len(h) - size + 1])) == len(h) - size + 1
    assert len(m.windows(h[:3], 5)) == 0
