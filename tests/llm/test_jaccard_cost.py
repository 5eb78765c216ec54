"""The Jaccard join hashes texts and deals sets many at once, and answers as if one by one."""

import numpy as np
import pytest

from sparkassay.llm import jaccard

ODD = [None, "", " ", "a", "  a b", "A b c D e", "a b c d ", "\t\n\x0b\x0c\r", "\x08a\x0eb \x1fc d e", "é ß\x0c中文 Привет", "a b a b a b a b", "x " * 30_000, ""]


@pytest.mark.parametrize("words", [1, 4])
def test_sets_do_not_depend_on_the_texts_beside(words):
    rng = np.random.default_rng(1)
    texts = [*ODD, *(" ".join(f"w{i}" for i in rng.integers(0, 50, n)) for n in rng.integers(0, 90, 400)), *ODD[::-1]]
    shingle, calls = jaccard.Shingler(words), []
    plain = shingle._sets
    shingle._sets = lambda some: calls.append(len(some)) or plain(some)
    together = list(shingle(texts))
    assert len(together) == sum(calls) == len(texts) and len(calls) < len(texts) / 20
    for text, members in zip(texts, together, strict=True):
        (alone,) = jaccard.Shingler(words)([text])
        np.testing.assert_array_equal(members, alone)
        w = (text or "").lower().replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.translate(str.maketrans("\t\n\r", "   ")).split(" ") if x]
        assert len(members) == len({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else ())


def test_sets_dealt_together_meet_as_they_must():
    sizes, rng = jaccard.Sizes(85, 100), np.random.default_rng(2)
    sets = []
    for size in (15, 16, 29, 30, 33, 59, 60, 70, 119, 300, 5000):
        base = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for gone in range(0, sizes.differences(size) // 2 + 1, max(1, size // 30)):
            changed = np.sort(np.append(base[gone:], rng.integers(0, 1 << 62, gone // 2).astype(np.uint64)))
            sets += [s for s in (base, changed) if len(s) >= 15]
    keys = [set() for _ in sets]
    for key, side, own in jaccard.heavy_keys(sets, sizes, 15):
        for k, i in zip(key.tolist(), own.tolist(), strict=True):
            keys[i].add(k)
        assert len(key) == len(side) == len(own)
    for i, members in enumerate(sets):
        alone = [k for key, _, _ in jaccard.heavy_keys([members], sizes, 15) for k in key.tolist()]
        assert len(alone) == len(keys[i]) and set(alone) == keys[i]
        for j in range(i):
            both = len(np.intersect1d(members, sets[j]))
            if 100 * both >= 85 * (len(members) + len(sets[j]) - both):
                assert keys[i] & keys[j]
