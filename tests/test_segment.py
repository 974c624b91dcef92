"""The segmentation kernel against a character-by-character statement of the rules."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lipika.functions.scripts import SCRIPT_RANGES, STRUCT
from lipika.operators.segment import runs, with_runs

CASES = ["", "   ", " \n\t ", "  abc  def  ", "नमस्ते दुनिया", "ಕನ್ನಡ पाठ mix", "क्‍ष क्‌ष", "á̂ b", "́abc", " ́x", "👩‍🔧 ok 🏳️‍🌈", "Привет мир", "你好 世界", "xx `á` ́y", "$x^2$", "```py\ncode```", "$$a$$ b $$c$$", "\\[x\\] \\(y\\)", "a```b", "$$ open", "\x01\x05x\x1c\x85 y", "½ ² ª º ff ﬁ", "a" * 2000, "x\r\ny\rz", "`c` `d`", " `c` ", "‍", "e `x`́z", "한국어 テスト 日本", "ஒரு தெலుగు বাংলা ગુજરાતી", "العربية עברית ελληνικά", "word, word", " " * 50_000 + "a", "`" * 999]
SLOT = {"COMMON": "NEUTRAL", "LATIN": "LATIN", "DEVANAGARI": "DEVANAGARI", "KANNADA": "KANNADA"}


def script(ch):
    cat = unicodedata.category(ch)
    if cat[0] in "ZNPS" or ch in "\t\n\x0b\x0c\r":
        return "COMMON"
    for name, ranges in SCRIPT_RANGES.items():
        if any(a <= ord(ch) <= b for a, b in ranges):
            return name
    return None if cat[0] == "M" or ch in "‌‍" or "︀" <= ch <= "️" else "UNKNOWN"


def expected(text, mode):
    text = unicodedata.normalize("NFC", text)
    inside = {i for m in re.finditer(STRUCT, text) for i in range(*m.span())}
    own, space, before = [], [], ("NEUTRAL", "COMMON")
    for i, ch in enumerate(text):
        s = script(ch)
        if i in inside:
            own.append(("CODE_MATH", "CODE_MATH"))
        elif s is None:
            own.append(before)
        else:
            before = (SLOT.get(s, "CATCHALL"), s)
            own.append(before)
        space.append(i not in inside and s is not None and (unicodedata.category(ch)[0] == "Z" or ch in "\t\n\x0b\x0c\r"))
    if mode == "leading":
        for i in reversed(range(len(text))):
            if space[i]:
                own[i] = own[i + 1] if i + 1 < len(text) else None
        for i in range(len(text)):
            if own[i] is None:
                own[i] = own[i - 1] if i else ("NEUTRAL", "COMMON")
    out = []
    for i, ch in enumerate(text):
        if out and out[-1][0] == own[i][0]:
            out[-1][1] += ch
        else:
            out.append([own[i][0], ch, i, own[i][1]])
    return [(slot, t, start, start + len(t), s) for slot, t, start, s in out]


def found(spark, texts, mode):
    frame = with_runs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), mode=mode)
    return [[tuple(r) for r in row["runs"]] for row in frame.orderBy("id").collect()]


@pytest.mark.parametrize("mode", ["leading", "neutral"])
def test_adversarial(spark, mode):
    assert found(spark, CASES, mode) == [expected(t, mode) for t in CASES]


ALPHABET = st.sampled_from([*"ab Z09.,$`\\[]()\n\t", "́", "̧", "é", "क", "ा", "्", "।", "ಕ", "ೆ", "ೂ", "б", "ω", "中", "‍", "️", "🏳", "\xa0", " ", "\x01", "²"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=60, max_size=60))
def test_random(spark, texts):
    for mode in ("leading", "neutral"):
        assert found(spark, texts, mode) == [expected(t, mode) for t in texts]


def test_nulls_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "a b", "y"), (2, "a b", "y")], "doc_id long, text string, runs string")
    assert sorted(r["doc_id"] for r in runs(frame).collect()) == [2, 2]
    assert runs(frame.limit(0)).count() == 0


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), mode="other")
