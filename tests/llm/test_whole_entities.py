"""Detection of personal data on a labelled set, coreference of bare mentions, checks and notations."""

import re

import pytest

from tomolake.llm import pii

KEYED = pii.Keyed(b"k")

#: (text, the strings in it that are personal data); labelled by hand.
LABELLED = [
    ("Yesterday John Smith called.", ["John Smith"]),
    ("President John Smith spoke", ["John Smith"]),
    ("Hi Paul Martin!", ["Paul Martin"]),
    ("Call Emma Brown today", ["Emma Brown"]),
    ("John Smith came. Later Smith left, and John's car with him.", ["John Smith", "Smith", "John"]),
    ("Mrs. García sang; García's song", ["García", "García"]),
    ("Anna Miller's dog met Miller", ["Anna Miller", "Miller"]),
    ("Вчера Иван Петров пришёл. Петров ушёл.", ["Иван Петров", "Петров"]),
    ("Ο Γεώργιος Παππάς ήρθε. Ο Παππάς έφυγε.", ["Γεώργιος Παππάς", "Παππάς"]),
    ("card 4111 1111 1111 1111 and 4845168114407329", ["4111 1111 1111 1111", "4845168114407329"]),
    ("from fe80::1ff:fe23:4567:890a to 2001:db8::1", ["fe80::1ff:fe23:4567:890a", "2001:db8::1"]),
    ("555 123 4567, 020 7946 0958 or 1-800-555-1234", ["555 123 4567", "020 7946 0958", "1-800-555-1234"]),
    ("mail a.b@c.org or call +1 (017) 555-7713", ["a.b@c.org", "+1 (017) 555-7713"]),
    ("server 10.2.3.4, 2001:0db8:0000:0000:0000:ff00:0042:8329", ["10.2.3.4", "2001:0db8:0000:0000:0000:ff00:0042:8329"]),
    ("at 1700000000123 ms, order 9807915762804491, 4111 1111 1111 1112", []),
    ("std::vector and a::b, 10:20:30, 1::", []),
    ("The Smith of Brown Street. In Miller We Trust", []),
    ("Later Smith left. Smith was no one's name here", []),
    ("12 345 6789 and 1234 567 8901, 2024 2025 2026", []),
]


@pytest.mark.parametrize(("text", "want"), LABELLED)
def test_labelled(text, want):
    assert [text[e.start : e.end] for e in pii.entities(text)] == want


def test_bare_mentions_take_the_full_name_s_surrogate():
    out = pii.rewrite("John Smith came. Later SMITH left; Smith's hat, John's coat. Dear Mrs. Smith", KEYED)[0]
    first, last = re.match(r"(\w+) (\w+) came", out).groups()
    assert first in pii.GIVEN["latin", "m"] and {first, last}.isdisjoint({"John", "Smith"})
    assert out == f"{first} {last} came. Later {last.upper()} left; {last}'s hat, {first}'s coat. Dear Mrs. {last}"
    greek = pii.rewrite("Ελένη Παππά", KEYED)[0].split()
    assert greek[0] in pii.GIVEN["greek", "f"] and greek[1] != "Παππά" and all("α" <= c.lower() <= "ώ" for c in greek[1])


def test_cards_keep_their_network_and_check():
    for c in ("4111111111111111", "378282246310005", "5555555555554444", "6011111111111117"):
        new = pii.rewrite(c, KEYED)[0]
        assert new != c and new[:2] == c[:2] and len(new) == len(c) and pii.luhn(new[:-1]) == int(new[-1])


def test_addresses_stay_addresses():
    out = pii.rewrite("fe80::1ff:fe23:4567:890a 2001:db8::1", KEYED)[0].split()
    assert all(pii._is_ipv6(x) for x in out) and [x.count(":") for x in out] == [5, 3]


def test_overlaps_take_the_first_kind():
    e = pii.entities('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" x4111111111111111@mail.org')
    assert [x.kind for x in e] == ["secret", "email"]
