"""Consistent form and garbled text."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lipika.llm import canonical, lookalike, mojibake

PAIRS = [
    ("Ｈｅｓｔ　９", "Hest 9"), ("ﬁne ﬀ ﬃ", "fine ff ffi"), ("a b c d", "a b c d"), ("half‐done", "half-done"), ("Yеstmօx", "Yestmox"), ("Нello", "Hello"),
    ("z​e⁠r﻿o­", "zero"), ("é", "é"), ("क़", "क़"), ("ೊ", "ೊ"), ("ೀ", "ೀ"), ("µ", "μ"), ("∆t", "Δt"), ("$$ ∆(x)", "$$ Δ(x)"), ("а̃", "ã"), ("ё", "ë"), ("x\r\ny\rz", "x\ny\nz"), ("a‌b", "ab"), ("가", "가"),
]
KEPT = ["70⁵80", "½ ² ª º", "café", "Cafe", "क्‍ष", "क्‌ष", "👩‍🔧", "☂️", "тест", "ψολσταβα", "१२३", "a\nb", "a  b", "a–b—c−d"]


def form(*texts):
    return canonical.canonical_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("given, wanted", PAIRS)
def test_same_look(given, wanted):
    assert form(given) == form(wanted) == [unicodedata.normalize("NFC", form(wanted)[0])]


def test_visible_differences_stay():
    assert form(*KEPT) == [unicodedata.normalize("NFC", t) for t in KEPT]


def test_nulls_empty_and_very_long():
    long = "é Ｈ" * 200_000
    assert form(None, "", long, None) == [None, "", "é H" * 200_000, None]
    assert form() == []
    assert form("a" + "́" * 5000)[0] == unicodedata.normalize("NFC", "a" + "́" * 5000)


BLOCKS = [(0x20, 0x7F), (0xC0, 0x250), (0x300, 0x370), (0x900, 0x980), (0xC80, 0xD00), (0x1100, 0x1200), (0xAC00, 0xAC40), (0x1E00, 0x1F00)]
LETTER = st.sampled_from(BLOCKS).flatmap(lambda b: st.integers(b[0], b[1] - 1)).map(chr).filter(lambda c: unicodedata.category(c) != "Cn")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(LETTER, max_size=12), max_size=30))
def test_is_nfc_and_stable(texts):
    plain = [t for t in texts if not any(canonical.tables().action[ord(c)] or canonical.tables().alike[ord(c)] for c in t)]
    assert form(*plain) == [unicodedata.normalize("NFC", t) for t in plain]
    once = form(*texts)
    assert form(*once) == once


BASE = "the judge of Hestmor kept seven letters beside the old mill"


def test_look_alike_pairs(spark):
    rows = [("a", BASE), ("b", BASE.replace(" ", " ")), ("c", BASE.replace("e", "е")), ("c", BASE.replace("e", "е")), ("d", BASE), ("e", BASE.replace("seven", "sevén")), ("f", BASE.upper()), ("g", "too sh­ort"), ("h", "too short"), ("i", None), (None, BASE), ("j", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "'x' as split", "1 as look", "2 as raw")
    got = {tuple(r) for r in lookalike.look_alike_pairs(docs).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert lookalike.look_alike_pairs(docs.limit(0)).count() == 0
    few = {tuple(r) for r in lookalike.look_alike_pairs(docs, expand=1).collect()}
    assert few == {("a", "b"), ("a", "c"), ("b", "c")}


WORDS = ["Hestmoré", "Vlimçé", "Ruskåk", "Morvë", "Elgñana", "Zanguül", "said", "kept", "letters", "beside", "“Bring", "it”", "when", "old", "mill’s", "søren", "naïve", "žorol"]


def garbled_docs(spark):
    clean = [" ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)] for j in range(14)) for k in range(300)]
    hindi = "सुबह की गली में लोग लालटेन लेकर खड़े थे और बातचीत वहीं भूल आया"
    bad = {
        "u1": clean[0].encode().decode("latin-1"),
        "u2": clean[1].encode().decode("cp1252", "replace"),
        "u3": hindi.encode().decode("latin-1"),
        "u4": hindi.encode().decode("mac_roman"),
        "u5": clean[2].encode().decode("latin-1").encode().decode("latin-1"),
        "u6": clean[3].encode("cp1252", "replace").decode("latin-1"),
        "u7": clean[4].encode("cp1252", "replace").decode("mac_roman"),
        "u8": hindi.encode().decode("cp1251", "replace"),
        "u9": hindi.encode().decode("ascii", "replace"),
        "v1": hindi.encode().decode("gb18030", "replace"),
    }
    traps = {"t1": "a bond of £757 at ½ price, © Hestmore § 54 ¶ 3", "t2": "NÃDUL and GÂGRAE sang YORÇÃO at 28 °C ± 3", "t3": hindi, "t4": "«стапол режем» (ρεζεμφι)", "t5": "Ｈｅｓｔ kept Yеstmox е́"}
    rows = [(f"c{k}", t, "one") for k, t in enumerate(clean)] + [(k, t, "one") for k, t in (bad | traps).items()] + [(f"h{k}", hindi, "two") for k in range(40)] + [(f"{k}{n}", t, "two") for k, t in traps.items() for n in range(6)] + [("n1", None, "one"), ("n2", "", None), (None, bad["u1"], "one")]
    return spark.createDataFrame(rows, "doc_id string, text string, name string").selectExpr("*", "'x' as source", "1 as restored"), bad, clean, hindi


def test_garbled(spark):
    docs, bad, clean, hindi = garbled_docs(spark)
    found = {r["doc_id"]: r for r in mojibake.garbled_records(docs).collect()}
    assert set(found) == set(bad)
    for k, text in (("u1", clean[0]), ("u3", hindi), ("u4", hindi), ("u5", clean[2])):
        assert found[k]["restored"] == text
    assert found["u9"]["lost"] > 0
    assert mojibake.garbled_records(docs.limit(0)).count() == 0


def test_swap_tables():
    assert "é".encode().decode("cp1252") == "Ã©" and mojibake.from_utf8("Ã©", "cp1252") == "é"
    assert mojibake.from_utf8("NÃO", "cp1252") is None
    assert "Á".translate(mojibake.letter_table("mac_roman", "cp1252")) == "ç"
