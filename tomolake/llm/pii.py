"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Each kind of entity has a canonical form (so that one phone number in two
notations is one entity) and a keyed permutation of the canonical forms of its
format: characters keep their class (digit, vowel, consonant, capital, script),
checked numbers keep their validity, given names keep gender and script, and the
notation of the occurrence is put back. A permutation cannot send two entities to
one surrogate; each is conjugate to a single cycle, so none maps to itself.
Distinctness is checked all the same, over all entities of the corpus; a kind with
a collision takes the next round of its key. A surrogate may be another entity's
real value; that entity is replaced as well, so surrogates stay apart.

Numbers that carry a check (cards, IBANs) count only where it holds. A document's
full names tell its bare mentions: a surname or given name that stands alone, with
or without a possessive, takes the surrogate that it has in the full name. Names are
found in scripts with capitals (Latin, Cyrillic, Greek).

Defined cases: null texts stay null; empty texts and texts without entities come
back unchanged; very long texts are rewritten whole; where entities overlap the
kinds take precedence in the order of ``entities``; repeated rows are rewritten
alike; an empty table gives an empty table; other columns are kept, but for one with
the name of the count, which gives way to it.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm import scratch
from tomolake.llm.textkit import lean

#: Given names by (script, gender); fixed values, in common use.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Beatriz Camille Carmen Caroline Charlotte Chloe Claire Clara Cristina Daniela Deborah Dorothy Elena Elisabeth Emily Emma Eva Fiona Francesca Gabriela Hannah Heike Helen Helga Ines Ingrid Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Manon Margaret Maria Marie Mary Nancy Nathalie Nicole Olivia Patricia Petra Rosa Sabine Sandra Sarah Silvia Sofia Sophie Susan Ursula Valentina".split(),
    ("latin", "m"): "Adam Alberto Alexander Andreas Andrew Antoine Anthony Benjamin Bernard Brian Carlos Charles Christian Daniel David Dieter Edward Enrique Eric Felix Fernando Francisco Frank Fritz George Georges Hans Heinrich Henry Hugo Jack Jacques James Javier Jean John Jorge Joseph Juan Julien Karl Klaus Laurent Lukas Manuel Mark Martin Matthew Michael Miguel Nicolas Olivier Pablo Paul Peter Philippe Pierre Ricardo Richard Robert Stefan Thomas Walter William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Εμμανουήλ Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
#: Titles and the gender they tell; fixed values.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f"}

#: Classes of characters that may stand for one another; fixed values.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãéèêëíîïóôöõúûü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
_CLASS = {c: (k, i) for k, x in enumerate(CLASSES) for i, c in enumerate(x)}
_GIVEN = {name: (key, i) for key, names in GIVEN.items() for i, name in enumerate(names)}

EMAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", re.A)
#: Numbers by their notation; each kind is a named group, tried in this order where a number begins.
NUMBER = re.compile(
    r"(?<![\w.\-])(?=[+(\d])(?:"
    r"(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>\d{13,19}(?!\w)|\d{4}(?P<s1>[ \-])\d{4}(?P=s1)\d{4}(?P=s1)\d{1,7}(?!\w)|\d{4}(?P<s2>[ \-])\d{6}(?P=s2)\d{5}(?!\w))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<phone>\+ ?1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)|\+ ?[2-9]\d{0,2}(?:[ ./\-]?\(?\d{1,5}\)?){2,6}(?!\w)"
    r"|\(\d{2,5}\) ?\d{3,4}[ .\-]?\d{3,5}(?!\w)|(?:1(?P<s3>[.\-]))?\d{3}(?P<s4>[.\- ])\d{3}(?P=s4)\d{4}(?!\w)|0\d{2,3} \d{3,4} \d{4}(?!\w)|0\d(?: \d{2}){4}(?!\w)|0\d{2,4}[ /\-]\d{5,8}(?!\w))"
    r")"
)
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z])")
KEYED = re.compile(r"(?i)(?<!\w)(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key)\s*[=:]\s*[\"']?(?=[A-Za-z_\-+/]*\d)([A-Za-z0-9_\-+/]{8,})")
PREFIXED = re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza)([0-9A-Za-z_\-]{12,})")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
#: Eight groups, or fewer around a double colon; the address itself is checked afterwards.
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:|:){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΆΈΉΊΌΎΏΑ-Ω][\w'’\-]+"
#: A capital word, its title, and the capital word ahead, which is left for the next match.
NAMES = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? )?(?P<first>{_CAP})(?=(?P<last>(?: {_CAP})?))")

SURNAME = re.compile(rf" {_CAP}")
BARE = re.compile(rf"(?<!\w){_CAP}")
POSSESSIVE = re.compile(r"['’]s?$")


# -- permutations -----------------------------------------------------------------------------


class Keyed:
    """Keyed permutations; ``rounds`` names the round of each kind's key."""

    def __init__(self, key: bytes, rounds: dict[str, int] | None = None):
        self.key, self.rounds = key, rounds or {}
        self.orders = {k: sorted(range(len(v)), key=lambda i: self._f(f"order:{k}:{self.rounds.get('name', 0)}", i)) for k, v in GIVEN.items()}
        self.place = {k: {i: p for p, i in enumerate(o)} for k, o in self.orders.items()}

    def _f(self, tweak: str, x: int) -> int:
        return int.from_bytes(hmac.new(self.key, f"{tweak}:{x}".encode(), hashlib.sha256).digest(), "big")

    def _feistel(self, x: int, na: int, nb: int, tweak: str, back: bool) -> int:
        a, b = divmod(x, nb)
        for r in range(7, -1, -1) if back else range(8):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._f(f"{tweak}:{r}", a)) % nb
            else:
                a = (a + sign * self._f(f"{tweak}:{r}", b)) % na
        return a * nb + b

    def number(self, x: int, radices: list[int], tweak: str) -> int:
        """x to another number of the same mixed radix, never to itself when there is another."""
        half, na, nb = len(radices) // 2, 1, 1
        for r in radices[:half]:
            na *= r
        for r in radices[half:]:
            nb *= r
        y = (self._feistel(x, na, nb, tweak, True) + 1) % (na * nb)
        return self._feistel(y, na, nb, tweak, False)

    def text(self, s: str, kind: str, tweak: str = "") -> str:
        """Each character to one of its class; case and other characters stay."""
        low = s.lower() if len(s.lower()) == len(s) else s
        spots = [(i, *_CLASS[c]) for i, c in enumerate(low) if c in _CLASS]
        if not spots:
            return s
        radices = [len(CLASSES[k]) for _, k, _ in spots]
        shape = "".join(str(_CLASS[c][0]) if c in _CLASS else f"[{c}]" for c in low)
        x = 0
        for (_, _, v), r in zip(spots, radices, strict=True):
            x = x * r + v
        y = self.number(x, radices, f"{kind}:{self.rounds.get(kind, 0)}:{tweak}:{shape}")
        out = list(low)
        for (i, k, _), r in zip(reversed(spots), reversed(radices), strict=True):
            y, v = divmod(y, r)
            out[i] = CLASSES[k][v]
        return "".join(n.upper() if o != p else n for n, o, p in zip(out, s, low, strict=True))

    def given(self, name: str) -> str:
        key, i = _GIVEN[name]
        order = self.orders[key]
        return GIVEN[key][order[(self.place[key][i] + 1) % len(order)]]


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    n = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - n % 97:02d}"


# -- detection --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    canonical: str


def _number(m: re.Match) -> Entity | None:
    """The entity of a number's notation; a phone number ends at its 15th digit's group."""
    kind, s = m.lastgroup if m.lastgroup in ("ipv4", "card", "ssn", "phone") else next(k for k in ("card", "phone") if m[k]), m[0]
    if kind == "ipv4":
        return Entity(*m.span(), kind, s) if all(int(x) < 256 for x in s.split(".")) else None
    while kind == "phone" and len(re.sub(r"\D", "", s)) > 15 and re.search(r"[ ./\-]", s):
        s = re.sub(r"[ ./\-][^ ./\-]*$", "", s)
    digits = re.sub(r"\D", "", s)
    if kind == "phone" and not 7 <= len(digits) <= 15 or kind == "card" and luhn(digits[:-1]) != int(digits[-1]):
        return None
    return Entity(m.start(), m.start() + len(s), kind, ("+" if s[0] == "+" else "") + digits)


def entities(text: str) -> list[Entity]:
    """The entities of a text, left to right, without overlaps (the kinds below take precedence in their order)."""
    found: list[Entity] = []
    has_digit = any(c in text for c in "0123456789")
    if has_digit:
        found += [Entity(*m.span(), "secret", m[0].lower()) for m in HEX.finditer(text)]
        found += [Entity(*m.span(1), "secret", m[1]) for p in (PREFIXED, KEYED) for m in p.finditer(text) if not HEX.fullmatch(m[1])]
    if "@" in text:
        found += [Entity(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if has_digit:
        for m in IBAN.finditer(text):
            s = m[0].replace(" ", "")
            if 15 <= len(s) <= 34 and iban_check(s[:2], s[4:]) == s[2:4]:
                found.append(Entity(*m.span(), "iban", s))
        if ":" in text or "-" in text:
            found += [Entity(*m.span(), "mac", re.sub(r"[:\-]", "", m[0]).lower()) for m in MAC.finditer(text)]
            found += [Entity(*m.span(), "ipv6", m[0].lower()) for m in IPV6.finditer(text) if _is_ipv6(m[0])]
        found += [e for m in NUMBER.finditer(text) if (e := _number(m))]
    found += _names(text)
    out: list[Entity] = []
    taken: list[tuple[int, int]] = []
    for e in found:  # texts hold few entities
        if all(e.end <= a or e.start >= b for a, b in taken):
            out.append(e)
            taken.append((e.start, e.end))
    return sorted(out, key=lambda e: e.start)


def _is_ipv6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def _names(text: str) -> list[Entity]:
    """Full names and titled ones, then bare mentions of their parts."""
    found: list[Entity] = []
    for m in NAMES.finditer(text):
        if m["title"] or (m["first"] in _GIVEN and m["last"]):
            last, end = ("", m.end("first")) if m["last"][1:] in TITLES else (m["last"], m.end("last"))
            cut = POSSESSIVE.search(last or m["first"])
            first = m["first"] if last or not cut else m["first"][: cut.start()]
            last, end = (last[: cut.start()] if last and cut else last), end - (len(cut[0]) if cut else 0)
            if m["title"] and m["first"] not in _GIVEN:  # a title and a surname; a second capital word belongs to it unless it begins a name
                if last[1:] in _GIVEN and SURNAME.match(text, end):
                    last, end = "", m.end("first")
                found.append(Entity(m.start("first"), end, "name", f"|{(first + last).lower()}"))
            elif m["title"] or last:
                found.append(Entity(m.start("first"), end, "name", f"{first}|{last[1:].lower()}"))
    if not found:
        return found
    parts = [e.canonical.partition("|") for e in found]
    given = {first for first, _, _ in parts if first}
    last = {x for _, _, x in parts if x and " " not in x}
    for m in BARE.finditer(text):
        word = POSSESSIVE.sub("", m[0])
        if word in given:
            found.append(Entity(m.start(), m.start() + len(word), "name", f"{word}|"))
        elif word.lower() in last:
            found.append(Entity(m.start(), m.start() + len(word), "name", f"|{word.lower()}"))
    return found


# -- replacement ------------------------------------------------------------------------------


def surrogate(e: Entity, keyed: Keyed) -> str:
    """The surrogate in canonical form."""
    k, c = e.kind, e.canonical
    if k == "email":
        local, _, domain = c.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{keyed.text(local, k, domain)}@{keyed.text(labels, 'domain')}.{top}"
    if k == "ipv4":
        x = [int(v) for v in c.split(".")]
        keep = 1 if x[0] in (10, 127) else 2 if x[:2] == [192, 168] else 0
        n = 0
        for v in x[keep:]:
            n = n * 256 + v
        n = keyed.number(n, [256] * (4 - keep), f"ipv4:{keyed.rounds.get(k, 0)}:{x[:keep]}")
        tail = []
        for _ in range(4 - keep):
            n, v = divmod(n, 256)
            tail.append(v)
        return ".".join(map(str, x[:keep] + tail[::-1]))
    if k == "phone":
        head = 2 if c[0] == "+" else 1 if c[0] == "0" else 0
        return c[:head] + keyed.text(c[head:], k, c[:head])
    if k == "card":
        new = c[:2] + keyed.text(c[2:-1], k, c[:2])  # two digits tell the network
        return new + str((luhn(new) + int(c[-1]) - luhn(c[:-1])) % 10)
    if k == "iban":
        new = keyed.text(c[4:], k, c[:2])
        return c[:2] + iban_check(c[:2], new) + new
    if k in ("mac", "ipv6") or (k == "secret" and re.fullmatch(r"[0-9a-f]{32,}", c)):
        spots = [i for i, x in enumerate(c) if x != ":"]
        n = keyed.number(int("".join(c[i] for i in spots), 16), [16] * len(spots), f"{k}:{keyed.rounds.get(k, 0)}:{[i for i, x in enumerate(c) if x == ':']}")
        out = list(c)
        for i in reversed(spots):
            n, v = divmod(n, 16)
            out[i] = "0123456789abcdef"[v]
        return "".join(out)
    if k == "name":
        first, _, last = c.partition("|")
        return f"{keyed.given(first) if first else ''}|{keyed.text(last, k)}"
    return keyed.text(c, k)


def _like(new: str, old: str) -> str:
    """``new`` (letters and digits) in the notation of ``old``: its separators and capitals."""
    chars = iter(new)
    out = [next(chars, "") if o.isalnum() else o for o in old]
    return "".join(n.upper() if o.isupper() else n for n, o in zip(out, old, strict=True))


def shown(e: Entity, found: str, keyed: Keyed) -> str:
    """The surrogate as it replaces the occurrence ``found``."""
    new = surrogate(e, keyed)
    if e.kind == "name":
        first, _, last = new.partition("|")
        old = found.split(" ")
        parts = ([first] if first else []) + last.split(" ")
        return " ".join(p if first and i == 0 else "".join(x.upper() if y.isupper() else x for x, y in zip(p, o, strict=False)) for i, (p, o) in enumerate(zip(parts, old, strict=False)))
    if e.kind == "email":
        return new.upper() if found.isupper() else "".join(x.upper() if y.isupper() else x for x, y in zip(new, found, strict=True))
    if e.kind == "ipv4":
        return new
    if e.kind in ("mac", "ipv6") or re.fullmatch(r"[0-9A-Fa-f]{32,}", found):
        plain = _like(re.sub(r"[^\w]", "", new), found.lower())
        return plain.upper() if found.upper() == found else plain
    return _like(re.sub(r"[^\w]|_", "", new), found) if e.kind != "secret" or re.fullmatch(r"[0-9A-Fa-f]+", found) else new


def rewrite(text: str, keyed: Keyed) -> tuple[str, int]:
    """(text with surrogates, number of entities)."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], shown(e, text[e.start : e.end], keyed)]
        at = e.end
    return "".join(out) + text[at:], len(found)


@lru_cache(maxsize=8)
def _keyed(key: bytes, rounds: tuple) -> Keyed:
    return Keyed(key, dict(rounds))


def surrogates(docs: DataFrame, key: bytes, rounds: dict[str, int]) -> DataFrame:
    """Every distinct entity of the corpus: (kind, canonical, surrogate)."""
    state = tuple(sorted(rounds.items()))

    @lean
    def run(batches):
        keyed = _keyed(key, state)
        for batch in batches:
            seen = {(e.kind, e.canonical): e for t in batch.column(0).to_pylist() if t for e in entities(t)}
            rows = [(*k, surrogate(e, keyed)) for k, e in seen.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["kind", "canonical", "surrogate"], dtype=object), schema=pa.schema([(n, pa.string()) for n in ("kind", "canonical", "surrogate")]), preserve_index=False)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, canonical string, surrogate string").distinct()


def collisions(table: DataFrame) -> list[str]:
    """The kinds in which two entities share a surrogate."""
    twice = table.groupBy("kind", "surrogate").agg(F.min("canonical").alias("a"), F.max("canonical").alias("b")).where("a <> b")
    return [r.kind for r in twice.select("kind").distinct().collect()]


def settle(docs: DataFrame, key: bytes, most_rounds: int = 8) -> dict[str, int]:
    """The round of the key for each kind, at which all surrogates of the corpus are distinct."""
    rounds: dict[str, int] = {}
    for _ in range(most_rounds):
        table = scratch.written(surrogates(docs, key, rounds), "surrogates")
        clash = collisions(table)
        scratch.remove(table)
        if not clash:
            return rounds
        for kind in clash:
            rounds[kind] = rounds.get(kind, 0) + 1
    raise ValueError(f"surrogates still collide after {most_rounds} rounds: {clash}")


def replace(docs: DataFrame, key: bytes, count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and with the number of entities as column ``count`` unless that is None."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    docs = docs.drop(count) if count else docs
    state = tuple(sorted(settle(docs, key).items()))

    @lean
    def run(batches):
        keyed = _keyed(key, state)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = [(None, 0) if t is None else rewrite(t, keyed) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                cols = list(part.columns)
                cols[at] = pa.array([t for t, _ in new], part.schema.field(at).type)
                names = list(part.schema.names)
                if count:
                    cols.append(pa.array([n for _, n in new], pa.int32()))
                    names.append(count)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, shape + (f", `{count}` int" if count else ""))
