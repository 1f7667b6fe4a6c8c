"""Secret scan with fixed patterns and character Markov models, in built-in functions only.

Fixed kinds are assignments, access keys and hexadecimal keys.  The method
adds strings of at least ``least`` characters that a first-order Markov model
of random strings explains better than one of ordinary identifiers: the
log-likelihood ratio of the character pairs must exceed the log prior odds.
Both models are trained from labelled samples by counting pairs; scores are
whole thousandths, so every engine gets the same sums.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.
U+0001 in a text is read as U+0002, which no pattern can match either.
Repeated rows give repeated results; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import MARK, literal, settled, with_spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16
#: Thousandths of a nat: about 400 ordinary strings to one random.
PRIOR = 6000
SAMPLE = 4000

# Words from which the ordinary identifiers of the sample are made.
WORDS = """access account action address array audio author banner before button buffer cache cancel category center change
channel client column command comment config connection content control count create current customer data date default delete
description device direction document download element email enable error event example expression factory field file filter
first folder format function general group handle header height image import index information input instance integration item
international language length library license list local location manager message method model module name network number object
operation option order output package page parameter parent password path pattern payment permission person player point position
previous process product profile project property provider query reader record reference region register release remote report
request resource response result return schedule screen search section select server service session setting simple single
source standard start state status storage stream string student subject system table target template their thing thread through
title token total transaction transfer translation type update user value version vertical video view visible which width window
within without worker world writer internationalization representation administration understanding nouveaux niveaux cheveux lieux curieux travaux tableaux bureaux
oiseaux ouvrier premier dernier jouer lequel quelque auquel lumineux heureux aiguille ouest iode cuenta archivo usuario acceso direcciones
quiero cualquier bosque asociado ocioso zugang benutzer datei verzeichnis kennwort gesellschaft schreiben zwischen achtzig""".split()


def _stream(label: str):
    block = 0
    while True:
        yield from hashlib.sha256(f"{label}/{block}".encode()).digest()
        block += 1


def labelled_sample(n: int = SAMPLE) -> list[tuple[str, int]]:
    """``n`` random strings (1) and ``n`` ordinary identifiers (0), by a fixed rule."""
    r = _stream("secret-sample")
    pick = lambda seq: seq[(next(r) << 8 | next(r)) % len(seq)]
    alphabets = [ALPHABET[:62], ALPHABET[:62], "0123456789abcdef", ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + "0123456789"]
    out = [("".join(pick(alphabet) for _ in range(16 + next(r) % 32)), 1) for alphabet in (pick(alphabets) for _ in range(n))]
    for _ in range(n):
        words = [pick(WORDS) for _ in range(2 + next(r) % 3)]
        style = next(r) % 6
        if style == 0:
            text = "".join([words[0], *(w.title() for w in words[1:])])
        elif style == 1:
            text = "".join(w.title() for w in words)
        else:
            text = pick("_-/_")[: style - 1 or 1].join(words) if style < 5 else "".join(words)
        if next(r) % 5 == 0:
            text = text.upper()
        if next(r) % 6 == 0:
            text += pick(["1", "2", "_2024", "-10", "/v2", "_01", "=1"])
        out.append((text, 0))
    return out


def weights(counts: dict[tuple[int, str], int]) -> list[int]:
    """Log-likelihood ratio of each pair (128 x code + code) from the pairs counted under labels 1 and 0."""
    out = [0] * (128 * 128)
    heads: Counter = Counter()
    for (label, pair), n in counts.items():
        heads[label, pair[0]] += n
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((counts.get((label, a + b), 0) + 0.25) / (heads[label, a] + 0.25 * len(ALPHABET)) for label in (1, 0))
            out[ord(a) * 128 + ord(b)] = round(1000 * math.log(p / q))
    return out


def train(spark: SparkSession, sample: list[tuple[str, int]] | None = None) -> list[int]:
    """Weights from labelled (text, 1 random or 0 ordinary) pairs; texts are of the alphabet."""
    sample = labelled_sample() if sample is None else sample
    lists = [F.lit(" ".join(t for t, k in sample if k == label)) for label in (0, 1)]
    rows = spark.range(1).select(F.posexplode(F.array(*lists)).alias("label", "all")).select("label", F.explode(F.split("all", " ")).alias("t")).filter("length(t) > 1")
    pairs = rows.select("label", F.explode(F.expr("transform(sequence(1, length(t) - 1), i -> substring(t, cast(i as int), 2))")).alias("pair"))
    return weights({(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()})


def train_locally(sample: list[tuple[str, int]] | None = None) -> list[int]:
    """The same weights without a session, for the SQL held against the query."""
    counts: Counter = Counter()
    for text, label in labelled_sample() if sample is None else sample:
        counts.update((label, text[i : i + 2]) for i in range(len(text) - 1))
    return weights(counts)


def find_secrets(docs: DataFrame, least: int = LEAST, prior: int = PRIOR, model: list[int] | None = None) -> DataFrame:
    """doc_id, number of spans of each fixed kind, and all spans as arrays ``base`` and ``added`` of (s, e, m)."""
    table = ",".join(map(str, model or train(docs.sparkSession)))
    pair = "cast(ascii(substring(p, cast(i as int), 1)) * 128 + ascii(substring(p, cast(i as int) + 1, 1)) as int)"
    score = f"aggregate(sequence(1, length(p) - 1), 0L, (a, i) -> a + cast(split('{table}', ',') as array<int>)[{pair}])"
    df = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), MARK, "\x02").alias("t"))
    df = with_spans(df, "t", ASSIGN, "assign", f"length(regexp_extract(p, {literal(ASSIGN)}, 2)) >= 6")
    df = with_spans(df, "t", ACCESS, "access")
    df = with_spans(df, "t", HEX, "hex")
    df = with_spans(df, "t", f"[A-Za-z0-9+/_=-]{{{least},}}", "markov", f"p rlike '[A-Za-z]' and {score} > {prior}")
    named = ", ".join(f"transform({k}, x -> struct(x.s as s, {i} as rank, x.e as e, '{k}' as kind))" for i, k in enumerate(KINDS[:3]))
    df = df.withColumn("base", F.expr(f"array_sort(concat({named}))"))
    # fixed spans take precedence; spans of each kind are in order and apart, so only texts with both need the comparison
    df = df.withColumn("added", F.expr("transform(filter(markov, x -> not exists(base, b -> b.s < x.e and x.s < b.e)), x -> struct(x.s as s, 3 as rank, x.e as e, 'markov' as kind))"))
    df = settled(df, ["doc_id"], ["base", "added", *KINDS[:3]])
    return df.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.size("added").cast("long").alias("n_markov"), "base", "added")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """The digest of ``find_secrets``: counts, the hash of the fixed spans, and all spans as text."""
    written = "array_join(transform({}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    return find_secrets(docs, **options).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.expr(written.format("base")), 256).alias("base_sha256"), F.expr(written.format("array_sort(concat(base, added))")).alias("spans"), "n_markov"
    )
