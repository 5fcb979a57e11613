"""Names after capitalised words."""

import pytest

from tomolake.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact John Smith", ["John Smith"]), ("Yesterday Anna Miller came", ["Anna Miller"]), ("Dear Alice Brown, ask Anna Miller", ["Alice Brown", "Anna Miller"]), ("Dear Dr. Brown", ["Brown"]),
        ("Herr Schmidt Anna Miller", ["Schmidt", "Anna Miller"]), ("Mr Smith Mrs Jones", ["Smith", "Jones"]), ("Drive Anna. Then The Erin", []), ("Mr. John Smith", ["John Smith"]), ("Herr Van Helsing", ["Van Helsing"]),
    ],
)
def test_names_after_capital_words(text, want):
    assert [text[e.start : e.end] for e in pii.entities(text)] == want


def test_names_stay_coreferent():
    out = pii.rewrite("Contact John Smith; ask John Smith", pii.Keyed(b"k"))[0]
    a, b = out.removeprefix("Contact ").split("; ask ")
    assert a == b != "John Smith"
