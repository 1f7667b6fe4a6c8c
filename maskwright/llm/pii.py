"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

``find`` locates e-mail addresses, card and other long numbers, IPv4 addresses,
phone and social-security numbers and personal names: after forms of address,
after words that announce a name, before an address in brackets, and from a
known first name on; later mentions of a part alone belong to the same person.
Each entity is reduced to a value (case, spacing and punctuation aside) that is
mapped by a keyed permutation without fixed points over all values of its
format; so equal values always get equal surrogates, in every document
(coreference), different ones different surrogates (distinctness), and no value
stays.  What a name is depends on its value alone: a listed first name is
exchanged within its script and gender wherever it stands, every other part of
a name by the letters.  Digits stay digits, letters stay letters of their
script and kind, a card number (told by its check digit) stays a valid one, and
the original's case, spacing and punctuation are put back.  Kept as they are:
top-level domains and country codes of phone numbers, which ``country_code``
tells from the digits, so it does not matter how a number is written.
``collisions`` checks distinctness over the whole corpus; should two values of
a kind ever share a surrogate, the next tweak of the key is used for all.

Null texts stay null, empty ones empty; repeated rows get equal results; all
other columns are kept as they are.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

KINDS = ("email", "card", "account", "ip", "ssn", "phone", "name")
DEFAULT_KEY = "maskwright-surrogates"

# First names by script and gender, forms of address, and words that announce a name.
FIRST_NAMES = {
    ("latin", "f"): """Anna Maria Laura Julia Sophie Emma Sarah Emily Olivia Lucia Carmen Elena Isabel Camille Chloe Claire Hannah Katharina Ingrid Alice
    Grace Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Lisa Margaret Sandra Ashley Michelle Amanda Melissa Rebecca Rachel
    Fatima Aisha Priya Mei Yuki Amina Leila Zainab Ayse Giulia Chiara Francesca Agnieszka Katarzyna Ines Beatriz Mariana Sofia Valentina Camila""".split(),
    ("latin", "m"): """James John Robert Michael William David Thomas Daniel Peter Paul Carlos Miguel Javier Pablo Pierre Antoine Lukas Stefan Andreas Henrik
    Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth George Edward Brian Ronald Kevin Jason Jeffrey Ryan Jacob Gary Eric
    Ahmed Mohammed Muhammad Omar Hassan Ali Ibrahim Yusuf Raj Arjun Wei Hiroshi Kenji Giovanni Marco Luca Piotr Jan Mateus Diego""".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split()
ANNOUNCED = ["name", "nombre", "nom", "contact", "customer", "patient", "employee", "author", "signed", "attn", "regards", "sincerely", "yours truly", "name is", "grüßen", "cordialement", "atentamente"]
# Letters that may stand for each other: sounds of a kind, so names stay speakable.
LETTERS = ["aeiou", "bdgkpt", "lmnr", "cfhsvwz", "jqxy", "áéíóúàèìòùâêîôûäëïöü", "çñßøåæœšžćčłńśź", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσφχψ", "άέήίόύώ"]
# Country calling codes of one and of two digits; all others have three.
CODES_1 = frozenset("1 7".split())
CODES_2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
RANGES = [(0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x0621, 0x063A), (0x05D0, 0x05EA), (0x0904, 0x0939)]

_CLASS_OF = {c: (letters, i) for letters in LETTERS for i, c in enumerate(letters)} | {d: ("0123456789", i) for i, d in enumerate("0123456789")}
_LIST_OF = {n.casefold(): (names, i) for names in FIRST_NAMES.values() for i, n in enumerate(names)}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = re.compile(
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}([ .\-])\d{1,4}(?:\4\d{2,4}){1,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}([.\-])\d{3}\5\d{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\7\d{4}\7\d{1,7}|\d{4}([ \-])\d{6}\8\d{5})(?![\w\-]))",
    re.ASCII,
)
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[^\W_](?:[\w-]{0,62})(?:\.[^\W_][\w-]{0,62})*\.[^\W\d_]{2,24}(?![\w-])")
_WORD = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*"
_CAPITAL = r"(?=[^\W\d_a-zß-öø-ÿа-яά-ώ])"
_NAMES = re.compile(
    rf"\b{_CAPITAL}(?:(?P<title>{'|'.join(TITLES)})\.?[ \t]+(?P<rest>{_WORD}(?:[ \t]+{_WORD}){{0,2}})|(?P<first>{'|'.join(n for names in FIRST_NAMES.values() for n in names)})[ \t]+(?P<last>{_WORD}(?:[ \t]+{_WORD})?))(?!\w)"
)
_TOLD = re.compile(rf"(?:[:,]\s*|(?<=name is)[ \t]+){_CAPITAL}({_WORD}(?:[ \t]+{_CAPITAL}{_WORD}){{1,2}})(?!\w)")
_BEFORE = re.compile(rf"\b{_CAPITAL}({_WORD}(?:[ \t]+{_CAPITAL}{_WORD}){{1,2}})[ \t]*[<(]$")
_ANNOUNCE = re.compile(rf"(?<!\w)(?:{'|'.join(ANNOUNCED)})$", re.I)
#: Characters before a name's place that are looked at for what announces it.
_LOOK_BACK = 120
_LOCAL = frozenset("._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and ((c := text[start - 1]).isalnum() or c in _LOCAL):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        found = _DOMAIN.match(text, at + 1)
        if start < at and found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _names(text: str, emails: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Tokens of personal names, and later mentions of a part alone."""
    known: set[str] = set()
    for m in _NAMES.finditer(text):
        parts = re.findall(_WORD, m["rest"] or m["last"])
        own = parts[: next((i for i, p in enumerate(parts) if not p[:1].isupper()), len(parts))]
        if own and m["first"] not in own:  # a word said twice is no first and last name
            known.update([m["first"], *own] if m["first"] else own)
    for m in _TOLD.finditer(text):
        if _ANNOUNCE.search(text[max(0, m.start() - _LOOK_BACK) : m.start()].rstrip()):
            known.update(re.findall(_WORD, m[1]))
    for a, _ in emails:
        if a and text[a - 1] in "<(" and (m := _BEFORE.search(text[max(0, a - _LOOK_BACK) : a])):
            known.update(re.findall(_WORD, m[1]))
    if known:
        for m in re.finditer(_WORD, text):
            if m[0] in known:
                yield m.start(), m.end(), "name"


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order, without overlaps."""
    if not text:
        return []
    emails = list(_emails(text))
    spans: list[tuple[int, int, str]] = [(a, b, "email") for a, b in emails]
    for m in _NUMBERS.finditer(text) if _DIGIT.search(text) else ():
        digits = [int(c) for c in m[0] if c.isdigit()]
        kind = next(k for k in ("ip", "ssn", "phone", "card") if m[k])
        if kind == "card" and _check_digit(digits[:-1]) != digits[-1]:
            kind = "account"
        if kind != "phone" or 7 <= len(digits) <= 15:
            spans.append((*m.span(), kind))
    spans += _names(text, emails)
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


class Surrogates:
    """The keyed maps.  ``tweak`` gives another family of maps under the same key."""

    def __init__(self, key: str, tweak: int = 0):
        self.key = f"{key}/{tweak}".encode()

    def __reduce__(self):
        key, _, tweak = self.key.decode().rpartition("/")
        return Surrogates, (key, int(tweak))

    def _noise(self, label: str, data: list[int], n: int) -> list[int]:
        out: list[int] = []
        block = 0
        while len(out) < n:
            d = hmac.digest(self.key, f"{label}|{block}|{','.join(map(str, data))}".encode(), "sha256")
            out += [int.from_bytes(d[i : i + 4], "big") for i in range(0, 32, 4)]
            block += 1
        return out[:n]

    def _shuffled(self, label: str, value: list[int], radix: list[int], sign: int) -> list[int]:
        """Rounds of keyed additions, each half shifted by the other: a permutation, undone by ``sign`` -1."""
        value = list(value)
        half = (len(value) + 1) // 2
        rounds = [(r, range(half, len(value)) if r % 2 else range(half)) for r in range(6)]
        for r, moved in rounds if sign > 0 else rounds[::-1]:
            moving = set(moved)
            rest = [v for i, v in enumerate(value) if i not in moving]
            for i, x in zip(moved, self._noise(f"{label}|{r}|{radix}", rest, len(moved)), strict=True):
                value[i] = (value[i] + sign * x) % radix[i]
        return value

    def permute(self, label: str, value: list[int], radix: list[int]) -> list[int]:
        """A permutation without fixed points of all values with these radices."""
        if not value or max(radix) < 2:
            return list(value)
        value = self._shuffled(label, value, radix, 1)
        for i in range(len(value)):  # the next value in counting order
            value[i] = (value[i] + 1) % radix[i]
            if value[i]:
                break
        return self._shuffled(label, value, radix, -1)

    def characters(self, label: str, text: str) -> str:
        """Letters and digits exchanged within their classes; everything else stays."""
        places, value, radix, back = [], [], [], []
        for i, c in enumerate(text):
            if c in _CLASS_OF:
                letters, at = _CLASS_OF[c]
                places.append(i), value.append(at), radix.append(len(letters)), back.append(letters)
            else:
                for low, high in RANGES:
                    if low <= ord(c) <= high:
                        places.append(i), value.append(ord(c) - low), radix.append(high - low + 1), back.append(low)
        out = list(text)
        for i, v, b in zip(places, self.permute(label, value, radix), back, strict=True):
            out[i] = b[v] if isinstance(b, str) else chr(b + v)
        return "".join(out)

    @lru_cache(maxsize=200_000)  # noqa: B019 - one instance per task
    def value(self, kind: str, value: str) -> str:
        """The surrogate of a normalised value."""
        if kind == "ip":
            return ".".join(map(str, self.permute("ip", [int(p) for p in value.split(".")], [256] * 4)))
        if kind == "card":
            body = [int(c) for c in value[:-1]]
            new = self.permute("card", body, [10] * len(body))
            return "".join(map(str, [*new, _check_digit(new)]))
        if kind == "email":
            local, _, domain = value.rpartition("@")
            head, _, top = domain.rpartition(".")
            return f"{self.characters('local', local)}@{self.characters('domain', head)}.{top}"
        if kind == "name" and value in _LIST_OF:
            names, i = _LIST_OF[value]
            return names[self.permute("first", [i], [len(names)])[0]].casefold()
        new = self.characters(kind, value)
        while kind == "name" and new in _LIST_OF:  # on along the permutation's cycle, which leaves the list where it began
            new = self.characters(kind, new)
        return new

    def replace(self, kind: str, original: str) -> str:
        """The surrogate in the original's spacing, punctuation and case."""
        new = self.value(kind, normal(kind, original))
        if kind in ("card", "account", "phone", "ssn"):
            head = country_code(original) if kind == "phone" else 0
            digits = iter(new)
            return original[:head] + "".join(next(digits) if c.isdigit() else c for c in original[head:])
        if kind == "ip":
            return new
        if len(new) != len(original):  # first names differ in length
            return new.upper() if original.isupper() and len(original) > 1 else new.title()
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, original, strict=True))


def _check_digit(body: list[int]) -> int:
    doubled = [2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(body))]
    return -sum(doubled) % 10


def country_code(phone: str) -> int:
    """Length of the part up to the end of a leading country code, separators and brackets included."""
    if not phone.startswith("+"):
        return 0
    digits = [(i, c) for i, c in enumerate(phone) if c.isdigit()]
    code = "".join(c for _, c in digits[:2])
    size = 1 if code[0] in CODES_1 else 2 if code in CODES_2 else 3
    return digits[size - 1][0] + 1


def normal(kind: str, original: str) -> str:
    """The value that decides which entities are the same."""
    if kind == "phone":
        return "".join(c for c in original[country_code(original) :] if c.isdigit())
    if kind in ("card", "account", "ssn"):
        return "".join(c for c in original if c.isdigit())
    return original if kind == "ip" else "".join(low if len(low := c.lower()) == 1 else c for c in original)


def _entities(key: str, tweak: int):
    @F.pandas_udf("array<struct<kind:string,value:string,surrogate:string>>")
    def run(texts: pd.Series) -> pd.Series:
        maps = Surrogates(key, tweak)
        out = []
        for text in texts.tolist():
            found = {}
            for a, b, kind in find(text if isinstance(text, str) else None):
                v = normal(kind, text[a:b])
                found[kind, v] = {"kind": kind, "value": v, "surrogate": maps.value(kind, v)}
            out.append(list(found.values()))
        return pd.Series(out)

    return run


def collisions(docs: DataFrame, key: str, tweak: int = 0) -> DataFrame:
    """Surrogates that stand for several values of a kind, or for themselves."""
    found = docs.select(F.explode(_entities(key, tweak)("text")).alias("e")).select("e.*")
    return found.groupBy("kind", "surrogate").agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low <> high OR low = surrogate")


def _replace(key: str, tweak: int):
    @F.pandas_udf("struct<text:string,counts:array<bigint>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        maps = Surrogates(key, tweak)
        new, counts = [], []
        for text in texts.tolist():
            text = text if isinstance(text, str) else None
            spans = find(text)
            n = dict.fromkeys(KINDS, 0)
            parts, at = [], 0
            for a, b, kind in spans:
                parts += [text[at:a], maps.replace(kind, text[a:b])]
                n[kind] += 1
                at = b
            new.append("".join([*parts, text[at:]]) if spans else text)
            counts.append(list(n.values()))
        return pd.DataFrame({"text": new, "counts": counts})

    return run


def surrogate_key(docs: DataFrame, key: str = DEFAULT_KEY, tries: int = 8) -> int:
    """The first tweak under which no two values of the corpus collide."""
    for tweak in range(tries):
        if not collisions(docs, key, tweak).take(1):
            return tweak
    raise ValueError("values collide under every tweak of the key")


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY, counts: bool = False) -> DataFrame:
    """``docs`` with the texts rewritten; with ``counts`` a column n_<kind> for each kind."""
    small_batches(docs.sparkSession)
    tweak = surrogate_key(docs, key)
    new = "_surrogates"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, _replace(key, tweak)("text"))
    columns = [F.col(f"{new}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *(F.col(f"{new}.counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS) if counts))
