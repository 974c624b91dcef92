"""Letters of a page that is on no list, learned from the letters around them."""

from collections import Counter

from lipika.llm import mojibake

WORDS = ("café señor niño canción élan déjà mañana corazón días señal año éclair présent détail étude idée soirée frère").split() * 30


def model():
    pairs = Counter()
    for w in WORDS:
        text = f" {w} "
        pairs.update(zip(text, text[1:]))
    return mojibake.Bigrams(dict(pairs))


def test_cipher_is_learned_and_sound_signs_stay():
    known = model()
    code = {"é": "☼§", "ñ": "☼¤", "ó": "☼¶", "í": "☼¬"}
    rows = Counter()
    for w in WORDS:
        text = f" {w} "
        for left, c, right in zip(text, text[1:], text[2:]):
            if c in code:
                rows["s", left, code[c], right] += 1
    learned = mojibake.Letters([dict(zip(("source", "left", "run", "right"), k)) | {"n": n} for k, n in rows.items()], known)
    got = Counter()
    for (_, left, run, right), n in rows.items():
        sure, letter = learned.read(known, "s", left, run, right)
        got[sure > 0.95 and code.get(letter) == run] += n
    assert got[True] >= 0.9 * sum(got.values())
    assert learned.read(known, "s", "a", "never seen", "b") == (0.0, "never seen")
    assert learned.read(known, "other", "f", "☼§", " ")[0] == 0.0
    assert mojibake.Letters([], known).read(known, "s", "f", "☼§", " ") == (0.0, "☼§")


def test_signs_that_are_meant_are_no_cipher():
    read = mojibake.Reader(model())
    for left, run, right in (("l", "™", " "), (" ", "½", " "), ("a", "é”", " "), ("a", " ", "b"), ("m", "ū", ".")):
        assert not mojibake.unexplained(read, left, run, right)
