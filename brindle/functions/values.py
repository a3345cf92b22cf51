"""Spoken and written values: amounts, durations, flags, kinds of business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import once, strings


def lookup(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])


def grouped_number(raw: Column) -> Column:
    """1.200.000 by thousands, 2,5 as a decimal, otherwise commas group."""
    read = lambda t: (
        F.when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit("")).try_cast("double"))
        .when(t.rlike(r"^\d+,\d{1,2}$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
        .otherwise(F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    )
    return once(F.btrim(F.btrim(raw), F.lit(",.")), read)


def word_number(text: Column) -> Column:
    """A number word, or two that add up."""
    t, table = F.lower(F.btrim(text)), lookup(V.NUMBER_WORDS)
    parts = F.split(t, r"\s+")
    pair = F.when(F.size(parts) == 2, F.try_element_at(table, F.get(parts, F.lit(0))) + F.try_element_at(table, F.get(parts, F.lit(1))))
    return F.coalesce(F.try_element_at(table, t), pair)


def scale_number(text: Column) -> Column:
    """Numerals with scale words: small scales multiply the open group, large ones close it."""
    digits, small, big, ones = map(lookup, (V.SPOKEN_DIGITS, V.SMALL_SCALES, V.BIG_SCALES, V.BOUND_ONES))
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    bare = F.transform(
        found,
        lambda w: F.when(
            w.endswith("ng") & F.try_element_at(digits, w).isNull() & F.try_element_at(digits, F.regexp_replace(w, "ng$", "")).isNotNull(),
            F.regexp_replace(w, "ng$", ""),
        ).otherwise(w),
    )
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("open"), F.lit(False).alias("seen"))

    def step(acc: Column, w: Column) -> Column:
        one, digit, s, b = (F.try_element_at(m, w) for m in (ones, digits, small, big))
        open_or_one = F.when(acc["open"] == 0, F.lit(1.0)).otherwise(acc["open"])
        closes = F.coalesce(b, F.when(one >= 1000, one))
        scales = F.coalesce(s, F.when(one < 1000, one))
        return F.struct(
            F.when(closes.isNotNull(), acc["total"] + open_or_one * closes).otherwise(acc["total"]).alias("total"),
            F.when(closes.isNotNull(), F.lit(0.0)).when(scales.isNotNull(), open_or_one * scales).when(digit.isNotNull(), acc["open"] + digit).otherwise(acc["open"]).alias("open"),
            (acc["seen"] | F.coalesce(one, digit, s, b).isNotNull()).alias("seen"),
        )

    return F.aggregate(bare, start, step, lambda acc: F.when(acc["seen"], acc["total"] + acc["open"]))


def amount(raw: Column) -> Column:
    """An amount in whole units, as BIGINT; nothing said is 0, unreadable is null."""
    shape = rf"([\d,.]+)\s*({V.AMOUNT_UNITS})?"
    # each step's value is made once, not again wherever a later one reads it
    factor = lambda unit: (
        F.when(unit.startswith("cr"), 1e7).when(unit.rlike("^(?:lakh|lac)"), 1e5).when(unit.rlike("^(?:million|mn|juta|milyon)"), 1e6)
        .when(unit.rlike("^(?:miliar|milyar)"), 1e9).when(unit.isin("k", "thousand", "ribu", "libo"), 1e3).otherwise(1.0)
    )

    def scaled(t: Column, number: Column) -> Column:
        unit = F.when(number.isNotNull(), F.regexp_extract(t, shape, 2)).otherwise(F.regexp_extract(t, r"(crore|cr|lakhs?|lacs?|million|thousand)", 1))
        spoken = word_number(F.regexp_replace(t, r"(crore|cr|lakhs|lakh|lacs|lac|million|thousand)", ""))
        return F.coalesce(number, spoken) * once(unit, factor)

    def read(t: Column) -> Column:
        return F.coalesce(once(grouped_number(F.regexp_extract(t, shape, 1)), lambda number: scaled(t, number)), scale_number(t))

    def said(low: Column) -> Column:
        stripped = F.btrim(low, F.lit(".!,"))
        nothing = stripped.isin(V.NOTHING) | stripped.rlike(r"^(?:no |none|nil|zero)")
        t = F.btrim(F.regexp_replace(F.regexp_replace(low, V.CURRENCY, " "), r"\s+", " "))
        return F.when(low.isNull() | (low == ""), None).when(nothing, F.lit(0)).otherwise(once(t, read))

    return once(F.lower(F.btrim(raw)), said).cast("long")


def months(raw: Column, as_of: Column) -> Column:
    """A duration in months; "since 2019" counts to ``as_of``, a bare number means years."""
    t = F.lower(F.btrim(raw))
    since = F.regexp_extract(t, r"(?:since|from)\s*((?:19|20)\d{2})", 1).try_cast("int")
    part = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    years, some, bare = part(r"([\d.]+)\s*(?:year|yr|saal|taon|tahun)"), part(r"([\d.]+)\s*(?:month|mah|buwan|bulan)"), part(r"([\d.]+)")
    spoken = word_number(F.regexp_replace(t, r"(years?|yrs?|saal|months?|mahine)", ""))
    return (
        F.when(since.isNotNull(), F.greatest(F.lit(0), (F.year(as_of) - since) * 12 + F.month(as_of)))
        .when(years.isNotNull(), F.floor(years * 12)).when(some.isNotNull(), F.floor(some))
        .when(spoken.isNotNull(), F.when(t.rlike("year|yr|saal|taon|tahun"), F.floor(spoken * 12)).otherwise(F.floor(spoken)))
        .otherwise(F.floor(bare * 12))
    ).cast("long")


def flag(raw: Column) -> Column:
    """True, false or null; affirmations are looked for first."""
    t = F.lower(F.btrim(raw))
    said = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    any_of = lambda xs: t.isin(xs) | F.arrays_overlap(said, strings(xs))
    return F.when(any_of(V.AFFIRM), True).when(any_of(V.DENY), False)


def first_kind(raw: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind of which an alias occurs in the text."""
    low, out = F.lower(raw), None
    for name, aliases in kinds.items():
        hit = F.exists(strings(aliases), lambda a: F.contains(low, a))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def entity_type(raw: Column) -> Column:
    return first_kind(raw, V.ENTITIES)


def industry(raw: Column) -> Column:
    return F.coalesce(first_kind(raw, V.INDUSTRIES), F.nullif(F.substring(F.btrim(raw), 1, 60), F.lit("")))


def bounded_int(raw: Column, lo: int, hi: int) -> Column:
    n = F.regexp_extract(raw, r"\d+", 0).try_cast("long")
    return F.when(n.between(lo, hi), n)


def spoken_amount(value: Column) -> Column:
    """Rupees as they are said: crore, lakh, thousand."""
    short = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.rint(x * 100) / 100), "0+$", ""), r"\.$", "")
    v = value.cast("double")
    return (
        F.when(value >= 10_000_000, F.concat(short(v / 10_000_000), F.lit(" crore rupees")))
        .when(value >= 100_000, F.concat(short(v / 100_000), F.lit(" lakh rupees")))
        .when(value >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit(" thousand rupees")))
        .otherwise(F.concat(value.cast("string"), F.lit(" rupees")))
    )


def verhoeff_valid(digits: Column) -> Column:
    """Whether twelve digits pass the Verhoeff test."""
    d = F.array(*[F.array(*map(F.lit, row)) for row in V.VERHOEFF_D])
    p = F.array(*[F.array(*map(F.lit, row)) for row in V.VERHOEFF_P])
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    left = F.aggregate(backwards, F.lit(0), lambda c, x: F.get(F.get(d, c), F.get(F.get(p, x["i"] % 8), x["d"])))
    return F.when(digits.rlike(r"^\d{12}$"), left == 0).otherwise(False)


def pan_valid(value: Column) -> Column:
    return (F.length(value) == 10) & F.contains(F.lit(V.PAN_HOLDERS), F.substring(value, 4, 1))


def redact_names(text: Column) -> Column:
    return F.regexp_replace(text, V.NAME_FIELD, "$1: " + V.PII_MASKS["person_name"].replace("[", r"\[").replace("]", r"\]"))
