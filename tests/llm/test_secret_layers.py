import pytest

from cadenza.llm.secrets import all_spans


@pytest.mark.parametrize("code", ["password = hunter%32abcdefg", "p%61ssword = hunter2abc", r'"token": "\u0061\u0062cdefghij"', r"secret : \x61bcdefgh%32", "secret%20= %61bcdefgh"])
def test_secrets_of_which_a_part_is_escaped(code):
    text = f"50% of %41 see {code}"
    assert ("assign", text.index(code) + code.startswith('"'), len(text) - code.endswith('"')) in all_spans(text)[1]
