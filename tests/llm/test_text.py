import random
import re

import numpy as np
import pyarrow as pa

from cartaspark.llm import text as T


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def split(s):
    return [w for w in re.split("[ \t-\r]+", lower(s)) if w]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abAB éß日\n\t .,\x0b") for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "x", None]


def test_words_equal_iff_hashes_equal():
    texts = random_texts(300)
    hashes, starts, ends, first = T.words(*T.utf8(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        own = split(t or "")
        assert len(own) == first[i + 1] - first[i]
        for w, h in zip(own, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_slices_do_not_change_hashes(monkeypatch):
    column = pa.array(random_texts(200, 1) + ["long " * 900, "z" * 5000])
    whole = T.words(*T.utf8(column))
    monkeypatch.setattr(T, "SLICE", 97)
    for a, b in zip(whole, T.words(*T.utf8(column)), strict=True):
        assert np.array_equal(a, b)


def test_shingle_sets_against_brute_force():
    texts = random_texts(200, 2)
    hashes, _, _, first = T.words(*T.utf8(pa.array(texts)))
    for t, s in zip(texts, T.shingle_sets(hashes, first, 5), strict=True):
        w = split(t or "")
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(s) == len(want)


def test_utf8_of_sliced_and_null_columns():
    data, offsets = T.utf8(pa.array(["ab", None, "c", "é"]).slice(1))
    assert bytes(data) == "cé".encode()
    assert offsets.tolist() == [0, 0, 1, 3]
