import pyarrow as pa
import pytest

from strataloom.functions import lexing


@pytest.mark.parametrize("text", ["", " \n", "if x == 1:\n    return 'a'  # b\n"])
def test_tokens_are_built_by_columns(text):
    lexers = pytest.importorskip("pygments.lexers")
    found = [{"tok_class": str(c), "tok": v} for c, v in lexers.get_lexer_by_name("python").get_tokens(text) if v.strip()]
    shape = pa.list_(pa.struct([("tok_class", pa.string()), ("tok", pa.string())]))
    assert lexing.columnar(lexers.get_lexer_by_name("python").get_tokens(text), {}).equals(pa.array([found], shape))
