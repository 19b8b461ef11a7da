"""Long words and long texts are judged whole."""

import random

import numpy as np

from casemill.llm import op03_quality as quality


def values(text):
    return dict(zip(*(x.tolist() for x in quality.features(text)), strict=True))


def test_long_words_are_read_to_their_end():
    head = b"Ab1" * 30
    clean, junk = head + b"word-word." * 50, head + b"#9$X" * 50
    assert values(clean) != values(junk)
    # every place of a long word counts
    for at in range(70, len(clean)):
        changed = clean[:at] + b"~" + clean[at + 1 :]
        assert values(changed) != values(clean)
    # other words are as they were
    rows, x = quality.features(b"Some words and more words")
    assert np.isclose((x**2).sum(), 1)


def test_glued_junk_is_told_from_glued_text():
    rng = random.Random(3)
    head = b"Xy0" * 25
    good = [head + b"".join(rng.choice([b"Some,", b"word.", b"text-", b"More:"]) for _ in range(200)) for _ in range(40)]
    bad = [head + bytes(rng.choice(b"0#A9$a%B1") for _ in range(1000)) for _ in range(40)]
    w = quality.fit_scorer(good[:30] + bad[:30], np.array([1.0] * 30 + [0.0] * 30))
    score = lambda t: (w[(f := quality.features(t))[0]] * f[1]).sum() + w[quality.ROWS]
    assert all(score(t) > 0 for t in good[30:]) and all(score(t) < 0 for t in bad[30:])


def test_long_repetitive_texts_get_a_vote():
    i = quality.LABELLERS.index("variety")
    assert quality.votes(b"the same few words come again " * 2000)[i] == quality.BAD
    assert quality.votes(" ".join(f"w{k % 2500}" for k in range(9001)).encode())[i] == quality.GOOD
