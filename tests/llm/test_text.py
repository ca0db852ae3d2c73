"""Vectorised text helpers and word-by-word tokens against plain Python on odd texts."""

import random

import numpy as np

from tracklens.llm import ctw, packing
from tracklens.llm.common import IS_SPACE, cuts, slices, word_hashes

ALPHABET = list("aBzÅé́̊0129.,'!?-\n\t\x0b\x0c\x1c\x1f\x85  　ΣσςİıßﬁＡ漢字😀\x01\x00") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", " ", " ", " "]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def joined(found):
    raw = [t.encode() for t in found]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)


def test_tokens_word_by_word():
    from tokenizers import Tokenizer

    import public_tokenizers

    whole, found = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), texts(1500, 1)
    for t, ids in zip(found, packing.WordTokens(packing.TOKENIZER).encode([t.encode() for t in found]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_and_bytes():
    found = texts(1500, 2)
    data, offsets = joined(found)
    with np.errstate(over="ignore"):
        hashes, counts = word_hashes(data, offsets)
        grams, starts = ctw.byte_grams(data, offsets)
    words = [t.encode().lower().split() for t in found]
    assert counts.tolist() == [len(w) for w in words]
    named = {}
    for w, h in zip([w for some in words for w in some], hashes.tolist(), strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    for k in range(len(found)):
        assert bytes((grams[starts[k] : starts[k + 1]] & 255).astype(np.uint8)) == found[k].encode().lower() + b"\xff"


def test_slices_cover():
    offsets = np.array([0, 5, 5, 100, 101, 102, 400, 400])
    parts = list(slices(offsets, 50))
    assert [lo for lo, _ in parts] == [0, *[hi for _, hi in parts[:-1]]] and parts[-1][1] == 7
    assert list(slices(np.zeros(1, np.int64))) == []


def test_long_rows_are_read_in_parts():
    found = [*texts(300, 5), " ".join(f"w{k}" for k in range(400_000)), "x" * 2_500_000 + " tail", "", " " * 1_200_000 + "end"]
    data, offsets = joined(found)
    with np.errstate(over="ignore"):
        hashes, counts, starts = word_hashes(data, offsets, places=True)
        words = [t.encode().lower().split() for t in found]
        assert counts.tolist() == [len(w) for w in words]
        tail = word_hashes(*joined(["tail", "end", "w399999"]))[0].tolist()
    ends = np.cumsum(counts)
    assert [hashes[ends[-3] - 1], hashes[-1], hashes[ends[-4] - 1]] == [tail[0], tail[1], tail[2]] and len(starts) == len(hashes)
    for limit in (1, 7, 64, 5000):
        places = cuts(data[:20_000], np.minimum(offsets, 20_000), limit)
        assert places[0] == 0 and places[-1] == 20_000 and all(IS_SPACE[data[p]] or p in offsets for p in places[1:-1])
