"""Token ids against the tokenizer itself, fillings against all fillings."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from foliant.llm import packing


@pytest.fixture(scope="module")
def ids():
    return packing._Ids(public_tokenizers.path(packing.TOKENIZER))


def test_ids_are_the_tokenizers(ids):
    draw = random.Random(3)
    letters = "abcXYZ'stremvldÀßéñµªº²³½·0123.,!?#%-_\"'<|>\x1c\x1f\x85\xa0\xadİıǅ東é\t\r\v\f\nÅŀ'LL'RE  "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 16))) for _ in range(20_000)]
    texts += [f"{a}{s}{b}" for s in ("<|endoftext|>", "<|startoftext|>", "<|x|>") for a in ("", "a ", "é\n") for b in ("", "b", " 東")]
    texts += [pattern.format(chr(c)) for c in range(0x250) for pattern in ("{0}", "a{0}b", "{0}{0}", "'{0}", "{0}'s")]
    for text in texts:
        assert ids(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_caches_are_bounded_and_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_RUNS", 3)
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    small = packing._Ids(public_tokenizers.path(packing.TOKENIZER))
    text = "the cat 東京 and the dog 東京 and a bird, the cat; größe 東 京 over the hill"
    for _ in range(3):
        assert small(text) == np.array(small.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(small.runs) <= 3 and len(small.words) <= 2


def dominates(a, b):
    """Can the pieces of b be put, in groups, into the pieces of a?"""

    def place(left, rest):
        return not rest or any(place([*left[:i], x - rest[0], *left[i + 1 :]], rest[1:]) for i, x in enumerate(left) if x >= rest[0])

    return a != b and place(list(a), sorted(b, reverse=True))


def test_fillings_waste_least_and_are_undominated():
    draw = random.Random(5)
    for _ in range(400):
        lengths = sorted(draw.sample(range(1, 30), draw.randint(1, 5)), reverse=True)
        counts, space = {x: draw.randint(0, 3) for x in lengths}, draw.randint(0, 40)
        every = []
        for take in itertools.product(*(range(min(counts[x], space // x) + 1) for x in lengths)):
            pieces = [x for x, k in zip(lengths, take, strict=True) for _ in range(k)]
            if sum(pieces) <= space:
                every.append(pieces)
        found = packing._filling(space, lengths, counts)
        assert found in every and sum(found) == max(map(sum, every))
        assert not any(dominates(other, found) for other in every)


def test_sequences_near_the_bound():
    draw = np.random.default_rng(1)
    for _ in range(3):
        histogram = {int(min(2048, max(1, x))): int(n) for x, n in zip(draw.lognormal(5, 1, 1500), draw.integers(1, 30, 1500), strict=True)}
        filled = packing.complete_bins(histogram)
        used = {x: 0 for x in histogram}
        for parts, times in filled:
            assert sum(parts) <= 2048
            for x in parts:
                used[x] += times
        assert used == histogram
        assert sum(n for _, n in filled) <= sum(k * v for k, v in histogram.items()) / 2048 + 2
