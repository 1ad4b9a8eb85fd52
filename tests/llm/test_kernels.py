"""Hashes of words in long texts."""

import numpy as np
import pyarrow as pa

from tendril.llm import kernels as K
from tendril.llm.quality import features


def test_long_texts_in_stretches(monkeypatch):
    g = np.random.default_rng(1)
    words = ["".join(map(chr, g.integers(97, 123, n))) for n in g.integers(1, 12, 300_000)]
    words[1000] = "x" * (K.SLICE_BYTES + 7)
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    assert len(data) > 3 * K.SLICE_BYTES
    found = K.words(data, np.array([0, len(data)]), K.SPACED, False)
    h = found.hashes()
    few = [0, 7, 999, 1000, 1001, 150_000, 299_999]
    alone = [K.words(np.frombuffer(words[k].encode(), dtype=np.uint8), np.array([0, len(words[k])]), K.SPACED, False).hashes()[0] for k in few]
    assert h[few].tolist() == alone
    assert len({w for w in words}) == len(np.unique(h))


def test_features_in_stretches(monkeypatch):
    g = np.random.default_rng(2)
    texts = pa.array(["".join(map(chr, g.integers(32, 127, n))) for n in (0, 1, 2, 5, 40, 3000)] + [None, "é" * 700])
    whole = features(texts)
    monkeypatch.setattr(K, "SLICE_BYTES", 64)
    assert np.allclose(features(texts), whole)
