"""Text functions: tokens, hashes, shingles, normalisation, language, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

MONTHS = "january february march april may june july august september october november december".split()


def strings(items) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def search_terms(text: Column) -> Column:
    """``words`` without stopwords and single characters."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(V.STOPWORDS))


def content_hash(text: Column, keep_empty_apart: bool = True) -> Column:
    """20 hex digits of the SHA-256 of the joined words.

    Texts without a word would all share one hash; by default they are told apart by the text itself.
    """
    joined = F.array_join(words(text), " ")
    if keep_empty_apart:
        joined = F.when(joined == "", F.coalesce(text, F.lit(""))).otherwise(joined)
    return F.substring(F.sha2(joined, 256), 1, 20)


def shingles(tokens: Column, width: int = 4) -> Column:
    """Runs of ``width`` tokens joined by spaces, repeats included; fewer tokens give one string, none gives none."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < width, F.array(F.array_join(tokens, " "))).otherwise(runs)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two shingle arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def tidy_inline(text: Column) -> Column:
    """No-break spaces to spaces, zero-width spaces out, runs of blanks to one, trimmed."""
    plain = F.translate(text, "\u00a0\u200b", " ")
    return F.btrim(F.regexp_replace(plain, r"[ \t]+", " "), F.lit(" \t\n\r\x0b\x0c"))


def plain_marks(text: Column) -> Column:
    """Curly quotes and dashes to ASCII, replacement characters out, blanks and empty lines collapsed."""
    out = F.translate(text, "\u2019\u2018\u201c\u201d\u2013\u2014\ufffd", "''\"\"--")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def block_key(text: Column) -> Column:
    return F.md5(F.lower(tidy_inline(text)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def script_language(text: Column) -> Column:
    """The language of the leading script, if it makes up over 5 % of the first 4,000 characters; else "en"."""
    sample = F.substring(text, 1, 4000)
    found = [
        F.struct(
            F.regexp_count(sample, F.lit(f"[\\x{{{lo}}}-\\x{{{hi}}}]")).alias("n"),
            (-F.coalesce(F.nullif(F.regexp_instr(sample, F.lit(f"[\\x{{{lo}}}-\\x{{{hi}}}]")), F.lit(0)), F.lit(1 << 20))).alias("first"),
            F.lit(name).alias("name"),
        )
        for name, (lo, hi) in V.SCRIPTS.items()
    ]
    best = F.array_max(F.array(*found))
    return F.when(best["n"] / F.greatest(F.length(sample), F.lit(1)) > 0.05, best["name"]).otherwise("en")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    at = F.array_position(strings(MONTHS), low)
    short = F.array_position(strings([m[:3] for m in MONTHS]), low)
    return F.nullif(F.greatest(at, short), F.lit(0)).cast("string")


def rewrite_matches(text: Column, pattern: str, replacement) -> Column:
    """``text`` with every match replaced by ``replacement(match)`` (null keeps the match)."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.transform(found, lambda m: F.coalesce(replacement(m), m))
    pieces = F.zip_with(gaps, made, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(pieces, "")


def _iso_match(kind: str):
    pattern = V.DATE_PATTERNS[kind]
    y, m, d = {"dmy": (3, 2, 1), "ymd": (1, 2, 3), "mdy": (3, 1, 2), "dmonthy": (3, 2, 1)}[kind]

    def iso(match: Column) -> Column:
        group = lambda n: F.regexp_extract(match, pattern, n)
        return _iso(group(y), _month_number(group(m)) if kind in ("mdy", "dmonthy") else group(m), group(d))

    return iso


def with_iso_dates(df: DataFrame, column: str, changes: str | None = None) -> DataFrame:
    """Dates in four notations rewritten as yyyy-MM-dd, one notation after another; impossible dates stay.

    ``changes`` names a column for how many dates were read, each counted once: those that begin with
    the day are counted as the year-first dates that they become.  Each notation is a projection of its
    own: nested in one expression, every level would evaluate the one below it twice.
    """
    if changes:
        df = df.withColumn(changes, F.lit(0).cast("long"))
    for kind, pattern in V.DATE_PATTERNS.items():
        here = F.col(column).rlike(pattern)
        if changes and kind != "dmy":
            iso = _iso_match(kind)
            read = F.array_compact(F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), iso))
            df = df.withColumn(changes, F.col(changes) + F.when(here, F.size(read)).otherwise(0))
        made = rewrite_matches(F.col(column), pattern, _iso_match(kind))
        df = df.withColumn(column, F.when(here, made).otherwise(F.col(column)))
    return df


def amounts_in(text: Column) -> Column:
    """How many rupee amounts ``annotate_amounts`` finds."""
    return (F.regexp_count(text, F.lit(V.PLAIN_AMOUNT)) + F.regexp_count(text, F.lit(V.SCALED_AMOUNT))).cast("long")


def annotate_amounts(text: Column) -> Column:
    """Rupee amounts followed by their value as "(INR n)", each once, whatever their notation."""

    def scaled(match: Column) -> Column:
        number = F.replace(F.regexp_extract(match, V.SCALED_AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double")
        unit = F.when(F.lower(F.regexp_extract(match, V.SCALED_AMOUNT, 2)).startswith("cr"), F.lit(1e7)).otherwise(F.lit(1e5))
        return F.concat(match, F.lit(" (INR "), (number * unit).cast("long").cast("string"), F.lit(")"))

    def plain(match: Column) -> Column:
        digits = F.replace(F.regexp_extract(match, V.RUPEES + r"(\d[\d,]{2,})", 1), F.lit(","), F.lit(""))
        return F.concat(match, F.lit(" (INR "), digits, F.lit(")"))

    # plain first: it skips scaled amounts, and what it adds is never scaled
    return rewrite_matches(rewrite_matches(text, V.PLAIN_AMOUNT, plain), V.SCALED_AMOUNT, scaled)


def alternation(items) -> str:
    """A pattern for any of ``items`` as whole words."""
    escaped = ["".join("\\" + c if c in ".+*?()[]{}|^$\\-" else c for c in x.lower()) for x in items]
    return r"\b(?:" + "|".join(escaped) + r")\b"


def canonical_terms(text: Column) -> Column:
    """Keys of the terms of which an alias occurs, in taxonomy order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(alternation(a)), F.lit(k)) for k, a in V.TERMS.items()]))


def clean_heading(text: Column) -> Column:
    h = F.btrim(text, F.lit(" #-|:•\t"))
    h = F.regexp_replace(h, r"\s+", " ")
    h = F.regexp_replace(h, r"(?i)^(faq'?s?|frequently asked questions)\s*[:-]?\s*", "")
    capital = (F.upper(h) == h) & (F.lower(h) != h) & (F.length(h) > 4)
    return F.trim(F.when(capital, F.initcap(h)).otherwise(h))


def is_silence(text: Column, script: str = "") -> Column:
    """Whether a recogniser's text is what it writes for silence rather than speech."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    bare = F.lower(F.trim(F.regexp_replace(t, r"[\.,!?…]+$", "")))
    out = t.rlike(r"^[\s\.,!?\-…’'\"]*$") | t.rlike(r"^[\[\(\*][^\]\)\*]*[\]\)\*]$") | bare.isin(V.SILENCE)
    return out | ((F.length(t) <= 40) & t.rlike(V.NON_LATIN)) if script == "latin" else out


def recovered_json(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, the whole text, or its outermost braces or brackets."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    brackets = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    trimmed = lambda c: F.btrim(c, F.lit(" \t\n\r"))
    return F.coalesce(good(trimmed(fenced)), good(trimmed(text)), good(braces), good(brackets))


def sentences(text: Column) -> Column:
    """Parts between an end mark with white space and a capital or digit."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])", -1)


def fill_template(template: Column, detail: Column) -> Column:
    stop = F.when(detail.rlike(r"[.!?]$") | (detail == ""), detail).otherwise(F.concat(detail, F.lit(".")))
    return F.replace(template, F.lit("{detail}"), stop)


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often and wherever it is read.

    Inside a lambda of a higher-order function a plain expression would be computed again for each element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column, block: int = 256) -> Column:
    """Running sums of an array of integers, in blocks, so that long arrays do not take quadratic work."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    starts = lambda xs: F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(block))
    parted = lambda xs: F.transform(F.transform(starts(xs), lambda k: F.slice(xs, k + 1, F.lit(block))), lambda part: F.struct(part.alias("part"), total(part).alias("sum")))
    before = lambda held, n: F.aggregate(F.slice(held, F.lit(1), n), F.lit(0), lambda a, b: a + b["sum"])
    own = lambda base, part: F.transform(part, lambda _, k: base + total(F.slice(part, F.lit(1), k + 1)))
    summed = lambda held: F.flatten(F.transform(held, lambda b, n: once(before(held, n), lambda base: own(base, b["part"]))))
    return once(numbers, lambda xs: once(parted(xs), summed))


def match_starts(df: DataFrame, matches: dict[str, tuple[str, str]], text: str, block: int = 256) -> DataFrame:
    """Adds columns with the place, from 0, of each match of a pattern in ``text``; {new column: (column of matches, pattern)}.

    Splitting a text by a pattern gives the gaps between its matches; a place is the sum of the gaps and matches
    before it.  The sums are taken in blocks, in columns of their own, so that none is computed again for each match;
    where nothing matches there is nothing to sum.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))

    def steps(found: str, pattern: str) -> Column:
        gone = F.concat(F.array(F.lit(0)), lengths(F.col(found)))
        return F.when(F.size(found) > 0, F.zip_with(lengths(F.split(text, pattern, -1)), gone, lambda g, m: g + m)).otherwise(F.array().cast("array<int>"))

    total = "aggregate({}, 0, (a, x) -> a + x)".format
    cut = f"transform(sequence(0, greatest(size(`_{{0}}`) - 1, 0), {block}), k -> slice(`_{{0}}`, k + 1, {block}))"
    parts = f"transform({cut}, p -> named_struct('part', p, 'sum', {total('p')}))".format
    own = f"transform(b.part, (y, k) -> base + {total('slice(b.part, 1, k + 1)')})"
    before = "array(aggregate(slice(`_{0}`, 1, n), 0, (a, x) -> a + x.sum))"
    places = f"if(size(`{{1}}`) = 0, cast(array() as array<int>), slice(flatten(transform(`_{{0}}`, (b, n) -> get(transform({before}, base -> {own}), 0))), 1, size(`{{1}}`)))".format
    df = df.withColumns({f"_{n}": steps(*m) for n, m in matches.items()})
    df = df.withColumns({f"_{n}": F.when(F.size(f"_{n}") > 0, F.expr(parts(n))) for n in matches})
    return df.withColumns({n: F.expr(places(n, m[0])) for n, m in matches.items()}).drop(*[f"_{n}" for n in matches])


_BITS = 12


def blocks(text: Column) -> Column:
    """A text in pieces of 8,192 code points, each 4,096 after the one before, for ``near`` and ``between``."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{2 << _BITS}}})).{{1,{1 << _BITS}}}"), F.lit(1))


def near(held: Column, start: Column, count: Column) -> Column:
    """Up to 4,096 code points of a text's ``blocks``; unlike a substring it does not count from the text's beginning."""
    return F.coalesce(F.substr(F.get(held, F.shiftright(start, _BITS)), start.bitwiseAND(F.lit((1 << _BITS) - 1)) + 1, count), F.lit(""))


def between(held: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text's ``blocks``, however many."""
    size = F.lit(1 << _BITS)
    more = F.transform(F.sequence(start, F.greatest(end - 1, start), size), lambda at: near(held, at, F.least(end - at, size)))
    return F.when(end > start, F.array_join(more, "")).otherwise(F.lit(""))
