"""Account numbers before words and numbers in capitals."""

import pytest

from folioscope.llm import pii


@pytest.mark.parametrize("after", ["", " EUR 500", " USD", " BIC COBADEFF", " 500", " X", "; EUR"])
@pytest.mark.parametrize("account", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947"])
def test_account_ends(account, after):
    text = f"{account}{after}"
    assert [text[a:b] for k, a, b, _, _ in pii.spans(text) if k == "iban"] == [account]


def test_no_account():
    assert not [s for s in pii.spans("DE88 3704 0044 0532 0130 00 EUR 500") if s[0] == "iban"]
    two = "DE89 3704 0044 0532 0130 00 NO93 8601 1117 947"
    assert [two[a:b] for k, a, b, _, _ in pii.spans(two) if k == "iban"] == [two[:27], two[28:]]
