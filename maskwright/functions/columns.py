"""The same functions as expressions on columns; none leaves the JVM.

Java patterns: Unicode classes are asked for with (?U), case-insensitivity of
all letters with (?iu).  ``length`` and ``substring`` count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# The patterns of ``vocabulary`` for Java, with possessive runs where nothing can be given back.
EMAIL = r"(?i)(?<![\p{L}\p{N}_.+-])[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,63}(?![\p{L}\p{N}_.-])"
IPV4 = r"(?<![\p{L}\p{N}_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}_]|\.[0-9])"
NUMBER = r"(?<![\p{L}\p{N}_-])[0-9]{13,19}(?![\p{L}\p{N}_-])"
PHONE = r"(?U)(?<![\p{L}\p{N}_-])(?:\(\s*\+?[0-9]{1,3}\s*\)\s*|\+[0-9]{1,3}[\s.-]|507[\s.-])?(?:\(?[0-9]{3}\)?[\s.-][0-9]{4}|\(?[0-9]{4}\)?[\s.-][0-9]{4}|\(?[0-9]{3}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}|[0-9]{8})(?![\p{L}\p{N}_-])"
#: Pattern of each kind, and a pattern that a text without a value of the kind mostly lacks, which is cheaper to look for.
NATIVE = {"email": (EMAIL, "@"), "ipv4": (IPV4, r"[0-9]\.[0-9]"), "number": (NUMBER, "[0-9]{13}"), "phone": (PHONE, "[0-9][0-9)]{2}")}


def _may_have(text: Column, kind: str) -> Column:
    told = NATIVE[kind][1]
    return text.contains(told) if told == "@" else text.rlike(told)


def words(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)


# Letters that fold to another one than their small form, made by rule; of those that fold to several, the German one alone.
_FOLDED = [(c.lower(), c.casefold()) for c in map(chr, range(0x80, 0x3000)) if c.casefold() != c.lower() and len(c.lower()) == len(c.casefold()) == 1]


def folded(text: Column) -> Column:
    """Small letters, folded for comparison."""
    return F.replace(F.translate(F.lower(text), "".join(a for a, _ in _FOLDED), "".join(b for _, b in _FOLDED)), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    return folded(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def native_values(text: Column, kind: str) -> Column:
    """All values of a kind, in order."""
    none = F.array().cast("array<string>")
    return F.when(_may_have(text, kind), F.regexp_extract_all(text, F.lit(NATIVE[kind][0]), 0)).otherwise(none)


def native_count(text: Column, kind: str) -> Column:
    return F.when(text.isNotNull(), F.when(_may_have(text, kind), F.regexp_count(text, F.lit(NATIVE[kind][0]))).otherwise(0).cast("long"))


def native_redact(text: Column, kinds: tuple[str, ...] = ("email", "ipv4", "phone")) -> Column:
    """Values of ``kinds`` replaced by the kind in brackets."""
    for kind in kinds:
        text = F.when(_may_have(text, kind), F.regexp_replace(text, NATIVE[kind][0], f"[{kind.upper()}]")).otherwise(text)
    return text


def preview(value: Column, keep: int = 3) -> Column:
    value = F.trim(value)
    return F.when(F.length(value) <= 2 * keep, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.substring(value, 1, keep), F.lit("…"), F.substring(value, -keep, keep)))


def is_safe(kind: Column, value: Column) -> Column:
    value = F.trim(value)
    folded = F.lower(value)
    domain = F.substring_index(folded, "@", -1)
    mail = (F.lower(kind) == "email") & folded.contains("@") & F.greatest(*(domain.endswith(d) for d in V.SAFE_DOMAINS))
    return value.rlike(rf"^(?i)(?:{V.PREFIXES})-[0-9]+(?:@(?:example\.(?:com|org|net)|demo\.local|local))?$") | mail | folded.isin(sorted(V.SAFE_LITERALS))


def canonical(kind: Column, value: Column) -> Column:
    value = F.trim(value)
    return folded(F.when(kind.isin(sorted(V.SPACED_KINDS)), F.regexp_replace(value, r"(?U)\s+", " ")).otherwise(F.regexp_replace(value, r"(?U)\W+", "")))


def prefix_of(kind: Column) -> Column:
    out = F.upper(kind)
    for k, prefix in V.PREFIX.items():
        out = F.when(kind == k, prefix).otherwise(out)
    return out


def placeholder(prefix: Column, number: Column) -> Column:
    """PREFIX-0001; numbers of more digits are kept whole."""
    text = F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return F.concat(prefix, F.lit("-"), text, F.when(prefix == "EMAIL", "@example.com").otherwise(""))


def case_class(text: Column) -> Column:
    """'none', 'upper', 'lower', 'title' or 'mixed'."""
    upper, lower = F.upper(text) == text, F.lower(text) == text
    title = ~F.exists(F.filter(words(text), lambda w: w.rlike(r"\p{L}") & (F.length(w) > 1)), lambda w: ~w.rlike(r"^\p{Lu}[\p{Ll}\p{N}]*\p{Ll}[\p{Ll}\p{N}]*$"))
    return F.when(~text.rlike(r"\p{L}"), "none").when(upper, "upper").when(lower, "lower").when(title, "title").otherwise("mixed")


def escape_cell(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.replace(F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<br>"))


def cell_kind(value: Column) -> Column:
    """The kind of data a table label announces, or null."""
    label = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), ":+$", ""))
    known = F.create_map(*(F.lit(x) for pair in V.CELL_LABELS.items() for x in pair))
    return known[label]


def label_file(label: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.trim(label), r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(text == "", V.DOCUMENT_LABEL).otherwise(text)
