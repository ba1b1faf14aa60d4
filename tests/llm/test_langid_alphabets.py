"""Languages of large alphabets, and transitions in the list as in the table."""

import random

import pytest

from vulnwave.llm import langid

FIRST = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]


def texts(pairs, seed, n, letters=800):
    """Two-letter words out of ``pairs``, without blanks."""
    r = random.Random(seed)
    return ["".join(r.choice(pairs) for _ in range(letters // 2)) for _ in range(n)]


def words(alphabet, seed, n):
    r = random.Random(seed)
    return [r.choice(alphabet) + r.choice(alphabet) for _ in range(n)]


def test_two_languages_of_large_alphabets():
    hangul = [chr(c) for c in range(0xAC00, 0xAC00 + 3000)]
    of = {"ko": words(hangul, 1, 2000), "zh": words(FIRST, 2, 2000), "zx": words(FIRST, 3, 2000)}  # two of one alphabet
    model = langid.build({k: [langid.normalise(t) for t in texts(w, 4, 32 if k == "zh" else 24)] for k, w in of.items()})
    for k, w in of.items():
        asked = texts(w, 5, 20, 60)
        assert model.predict(asked)[0] == [k] * 20
    seen = 32 * 800 + 2 * 24 * 800
    assert len(model.points) > 4000 and len(model.keys) <= 3 * (seen + 80)


@pytest.mark.parametrize("letters", [0, 1, 5])
def test_list_moves_as_the_table(letters):
    r = random.Random(7)
    sample = {k: [langid.normalise(" ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(60)))] for k, a in (("x", "abcdefg"), ("y", "efghijk"))}
    asked = [langid.normalise(" ".join("".join(r.choice("abcdefghijkzü") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 300)))) for _ in range(30)]
    whole, listed = langid.build(sample), langid.build(sample, letters)
    assert not len(whole.keys) and len(listed.keys)
    assert listed.phrases(asked).tolist() == whole.phrases(asked).tolist()
