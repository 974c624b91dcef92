"""Operators work in a process that has loaded nothing before them."""

import subprocess
import sys

import pytest
from conftest import ROOT

PIECES = {
    "canonical": "from lipika.llm.canonical import canonical_array as f; assert f(pa.array(['ａ', None, ''])).to_pylist() == ['a', None, '']",
    "tokens": "from lipika.llm.tokens import _counted as f; b = pa.RecordBatch.from_pydict({'text': pa.array(['a b', None, ''])}); "
    "assert next(f(iter([b]), '/opt/tokenizers/byte_bpe_multi_50k.tiktoken', 'text'))['tokens'].to_pylist()[1:] == [0, 0]",
}


@pytest.mark.parametrize("name", sorted(PIECES))
def test_null_text_first(name):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import pyarrow as pa; {PIECES[name]}"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
