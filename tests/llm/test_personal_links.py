"""Base matches of several tokens and their later spellings share a skip edge."""

import numpy as np
import pytest

from wattline.llm.personal import HASHES, KINDS, LABELS, NONE, Field, all_spans, base_spans, graph_of, span_keys

SKIP = np.full((LABELS, LABELS), -5.0) + np.eye(LABELS) * 10
PLAIN = Field(np.zeros((HASHES + 1, LABELS)), np.zeros((LABELS, LABELS)), SKIP)


def linked(text):
    g = graph_of(text, base_spans(text))
    return {(text[slice(*g.spans[a])], text[slice(*g.spans[b])]) for a, b in g.skip}


@pytest.mark.parametrize("later", ["301234567", "49301234567", "(0)30-1234567", "0049301234567", "9301234567"])
def test_a_number_is_met_again_in_other_spellings(later):
    text = f"Call +49 30 1234567 today. The same is {later}, she said, or 987654321."
    assert ("1234567", later.strip("()")) in linked(text) or any(a == "1234567" for a, _ in linked(text))
    kinds = {text[s:e]: (KINDS[k], base) for k, s, e, base in all_spans(text, PLAIN, 0.95)}
    assert kinds["+49 30 1234567"] == ("phone", True)
    assert any(kind == "phone" and not base for kind, base in kinds.values()) and "987654321" not in kinds


def test_earlier_spellings_as_well():
    text = "First 301234567 and then +49 30 1234567."
    assert linked(text) == {("301234567", "1234567")}
    assert [(KINDS[k], base) for k, _, _, base in all_spans(text, PLAIN, 0.95)] == [("phone", False), ("phone", True)]


def test_other_numbers_are_not_linked():
    assert linked("+49 30 1234567 and 30123456 and 01234 and 7654321") == set()
    assert linked("a@b.de writes to A@B.de") == {("a@b.de", "A@B.de")}
    assert linked("4111 1111 1111 1111 is 4111111111111111") == {("1111", "4111111111111111")}


def test_keys():
    assert span_keys("+49 30 1234567", 3) == {"49301234567", "9301234567", "301234567", "1234567"}
    assert span_keys("4111-1111", 2) == {"41111111"} and span_keys("A@B.de", 0) == {"a@b.de"} and span_keys("10.0.0.1", 1) == {"10001"}
    assert NONE == len(KINDS)
