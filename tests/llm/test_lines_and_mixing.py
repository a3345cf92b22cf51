import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from brindle.llm import lines, mixing, queries

from .fixtures import AWKWARD, DATA, documents


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    cut = lambda t: [p.strip(" \t\r") for p in t.split("\n")]
    order = lambda d: (d is not None, d or 0)  # noqa: E731 - nulls sort first
    for d, t, s in rows:
        for n, p in enumerate(cut(t) if t is not None else []):
            if p:
                sites[p] |= {s} - {None}
                first[p] = min(first.get(p, (True, 1 << 60, 0)), (*order(d), n))
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        kept = [p for n, (p, c) in enumerate(zip(t.split("\n"), cut(t))) if not c or len(sites[c]) < min_sites or first[c] == (*order(d), n)]
        total = len(t.split("\n"))
        out.append((d, total, total - len(kept), "\n".join(kept)))
    return out


def same(got, want):
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_lines_whole_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op5_line_dedup(spark, DATA).collect()
    same(got, brute_lines(rows, lines.MIN_SITES))
    assert sum(r.n_removed for r in got) > 0


def test_lines_both_ways_and_awkward(spark):
    rows = AWKWARD + [(100 + n, f"own {n}\n Shared line \r\n\nsecond\nShared line", f"site{n % 9}") for n in range(40)]
    rows += [(200 + n, "near\nthreshold", f"site{n % 4}") for n in range(20)] + [(300 + n, "spread\nthreshold", f"site{n % 5}") for n in range(20)]
    df = documents(spark, rows)
    want = brute_lines(rows, 5)
    for most in (1_000_000, 0):  # by broadcast, by joins
        same(lines.line_report(df, most_broadcast=most).collect(), want)
        out = lines.remove_boilerplate(df, most_broadcast=most)
        assert out.columns == df.columns
        assert Counter(r.text for r in out.collect()) == Counter(w[3] for w in want)
    assert lines.line_report(documents(spark, [])).count() == 0


def test_lines_keep_columns_of_any_name(spark):
    names = ["text_key", "its_doc", "its_key", "drop_lines", "lines_before", "LINES_REMOVED", "_drop", "hash", "doc"]
    rows = [(n, f"own {n}\nshared", f"site{n % 7}") for n in range(30)]
    df = documents(spark, rows).select("doc_id", "text", "source").withColumns({n: F.lit(n) for n in names})
    for most in (1_000_000, 0):
        out = lines.remove_boilerplate(df, most_broadcast=most)
        assert out.columns == df.columns
        assert all(all(r[n] == n for n in names) for r in out.collect()) and out.filter("text like '%shared'").count() == 1


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def check_mix(got, rows):
    size = lambda t: len([w for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    want = brute_targets(dict(per))
    assert len(got) == len(rows)
    key = lambda i: (i is None, i or 0)
    source = {i: s for i, _, s in rows}
    assert sorted((key(r.doc_id), r.size) for r in got) == sorted((key(i), size(t)) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == per[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is not None) == (r.taken > 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 1
    shown = [r.position for r in got if r.position is not None]
    assert shown == sorted(shown)


def test_mix_whole_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op8_source_mixing(spark, DATA).collect()
    check_mix(got, rows)
    assert got == queries.op8_source_mixing(spark, DATA).collect()


def test_mix_awkward(spark):
    rows = AWKWARD[:6] + [(10, "a b c", "small"), (11, "w " * 900, "large"), (12, "w " * 40, "large")]
    check_mix(mixing.allocate(documents(spark, rows), rows_per_range=2).collect(), rows)
    assert mixing.allocate(documents(spark, [])).count() == 0


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for first, last in mixing.SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"), mixing.due(F.col("id") / 100, F.lit(first), F.lit(last)).alias("t")).collect()
        for r in rows:
            assert abs((first * r.t + (last - first) * r.t**2 / 2) / ((first + last) / 2) - r.u) < 1e-6
