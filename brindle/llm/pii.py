"""Personal data in whole texts (operator 1), by DataFrame expressions only.

Regular expressions propose spans, leftmost and without overlap within a kind; checksums (Luhn for
cards, mod 97 for bank accounts) confirm or drop them; context words in the ``reach`` characters
before and after a span adjust its score.  Spans that score ``accept`` or more stay.

Kinds: email, ip, card, phone (the base kinds, which stay whenever they validate), then iban (a
bank account number, needs mod 97), ssn (three, two and four digits: needs a context word) and secret
(an unbroken run of 20 or more letters, digits and + / _ - with at least four letters and four digits:
needs a context word, unless it begins as issued keys do).

Positions come from the gaps between matches: splitting a text by the pattern gives the gaps,
extracting gives the matches, and the running sum of their lengths (in code points) gives the
starts.  The sums are taken in blocks and the context is read from pieces of the text, each made once, so
the work is in proportion to a text's matches.  The patterns
use possessive repeats and start only where a run starts or the previous match ended, which leaves
the matches as they are but makes the scan linear even on texts of one endless word.

Defined results: null counts as empty; no matches give empty strings and zero counts; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks, match_starts, near

# The proposing patterns.
_MAIL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_OPAQUE = "[A-Za-z0-9+/_-]"
SECRET = rf"(?<!{_OPAQUE}){_OPAQUE}{{20,}}+"
#: How keys of well-known issuers begin.
ISSUED = "^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)"
# A part of at most 255 with any zeros before it; words that make a span likelier.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|bank|account",
    "ssn": "ssn|social security",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer|auth",
}
#: Score of a confirmed span, and what a context word adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5), "secret": (0.3, 0.5)}
#: A text without this cannot match, and is not scanned by the costly pattern.
_NEEDS = {"email": "@", "phone": "+"}
_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "secret": SECRET}
_HINTS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": _OPAQUE + "{20}"}
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(backwards, lambda d, n: F.when(n % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four signs moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = F.transform(signs, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return (F.regexp_count(match, F.lit("[0-9]")) >= 4) & (F.regexp_count(match, F.lit("[A-Za-z]")) >= 4)
    return F.lit(True)


def _confirmed(kind: str, reach: int, accept: float) -> Column:
    """The spans of one kind that pass their checksum and score enough."""
    base, bonus = SCORES[kind]
    told = rf"\b(?:{WORDS[kind]})"

    def span(match: Column, at: Column) -> Column:
        end, first = at + F.length(match), F.greatest(at - reach, F.lit(0))
        context = F.lower(near(F.col("held"), first, at - first)).rlike(told) | F.lower(near(F.col("held"), end, F.lit(reach))).rlike(told)
        score = F.lit(base) + F.when(context, F.lit(bonus)).otherwise(0.0)
        if kind == "secret":
            score = F.when(match.rlike(ISSUED), 0.9).otherwise(score)
        return F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), score.alias("score"), match.alias("text"))

    return F.filter(F.zip_with(f"m_{kind}", f"s_{kind}", span), lambda x: _valid(kind, x["text"]) & (x["score"] >= F.lit(accept)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, accept: float = 0.5) -> DataFrame:
    """doc_id and found: an array of (kind, start, end, score, text), by kind as listed, then start.

    Offsets are code points from 0, end exclusive; ``reach`` is at most 4,096.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        hint = F.contains("text", F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col("text").rlike(_HINTS[kind])
        return F.when(hint, F.regexp_extract_all("text", F.lit(_PATTERNS[kind]), F.lit(0))).otherwise(none)

    df = df.withColumns({f"m_{kind}": matches(kind) for kind in _PATTERNS})
    some = F.coalesce(*[F.when(F.size(f"m_{kind}") > 0, F.lit(True)) for kind in _PATTERNS], F.lit(False))
    df = match_starts(df.withColumn("held", F.when(some, blocks(F.col("text"))).otherwise(none)), {f"s_{kind}": (f"m_{kind}", pattern) for kind, pattern in _PATTERNS.items()}, "text")
    return df.select("doc_id", F.concat(*[_confirmed(kind, reach, accept) for kind in _PATTERNS]).alias("found"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans and their scores as text, and counts of the other kinds."""
    df = find(docs, id_col, text_col)
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"].isin(*BASE)), text), ",")
    return df.select(
        "doc_id", *[of(kind) for kind in BASE],
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("found", text), ",").alias("spans"),
        F.array_join(F.transform("found", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"), *[of(kind) for kind in _PATTERNS if kind not in BASE],
    )
