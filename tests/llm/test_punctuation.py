import pytest

from lipika.llm import mojibake


@pytest.mark.parametrize("text, hits", [("Vekthra„m was", ["„"]), ("caf‚ was", ["‚"]), ("d…j", ["…"]), ("k”nig", ["”"]), ("he said „so“ and … left – don’t", []), ("wait… and “no”", [])])
def test_punctuation_between_letters_is_read(text, hits):
    assert [run for *_, run, _ in mojibake.runs(text)] == hits


def test_rows_do_not_touch():
    import pyarrow as pa

    assert mojibake.suspicious_rows(pa.array(["ab", "„", "cd", "x„m"])).tolist() == [3]
