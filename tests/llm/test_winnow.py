import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import queries, winnow

from .fixtures import AWKWARD, DATA, documents

MASK = (1 << 64) - 1


def chained(tokens):
    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h & 0xFFFFFFFF


def brute(text, gram=4, window=8):
    """(hash, position) of the kept hashes, in order."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    if len(tokens) < gram:
        hashes = [chained([" ".join(tokens)])] if tokens else []
    else:
        hashes = [chained(tokens[i : i + gram]) for i in range(len(tokens) - gram + 1)]
    out = []
    for i in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        part = hashes[i : i + window]
        at = i + max(n for n, h in enumerate(part) if h == min(part))
        if (hashes[at], at) not in out[-1:]:
            out.append((hashes[at], at))
    return out


def told(found):
    return ",".join(f"{h:08x}:{p}" for h, p in found)


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """doc_id -> the row, for distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        r = len(text) // 3
        edited = text[: len(text) - r] + following[:r]
        a, b = brute(text), brute(edited)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), likeness(a, b), likeness(a, brute(following)))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id]), r.doc_id


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(queries.op12_document_fingerprints(spark, DATA).collect(), expected(docs))


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] != 4] + [(8, "a b c", "s"), (9, "word " * 40, "s"), (10, "\U0001f600" * 30 + " é x", "s"), (-3, "a b c d", "s")]
    check(winnow.digest(documents(spark, rows)).collect(), expected([r[:2] for r in rows]))
    assert winnow.digest(documents(spark, [])).count() == 0
    one = winnow.digest(documents(spark, [(1, "a b c d e f", "s")])).collect()
    check(one, expected([(1, "a b c d e f")]))


def test_hot_ids_are_cut_by_their_texts(spark):
    rng = random.Random(4)
    rows = [(7 if n % 3 else None if n % 2 else n, f"text {rng.random()} of row {n}", "s") for n in range(900)] + [(5, "same", "s")] * 40
    found = winnow.followed(documents(spark, rows), {})
    got = found.collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.text) for r in got) == sorted((key(i), t) for i, t, _ in rows)
    # the pairs are one ring through all rows, by descending id
    assert sorted(r.next_text for r in got) == sorted(t for _, t, _ in rows)
    ids = {t: i for i, t, _ in rows}
    falls = [r for r in got if key(ids[r.next_text]) > key(r.doc_id)]
    assert len(falls) == 1  # after the last comes the first
    total = documents(spark, rows).withColumn("mix", F.shiftrightunsigned(F.xxhash64("text"), 1))
    bounds = total.agg(F.percentile_approx("doc_id", [n / 64 for n in range(1, 64)], 10_000)).first()[0]
    assert total.filter("doc_id = 7").select(winnow._bin(F.col("doc_id"), F.col("mix"), bounds, 8).alias("b")).distinct().count() > 20


def test_shared_runs_share_a_mark(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    rows = []
    for n in range(40):
        run = [word() for _ in range(11)]
        for side in (0, 1):
            rows.append((2 * n + side, " ".join([word() for _ in range(rng.randint(0, 30))] + run + [word() for _ in range(rng.randint(0, 30))]), "s"))
    marks = {r.doc_id: {m.hash for m in r.marks} for r in winnow.fingerprints(documents(spark, rows)).collect()}
    assert all(marks[2 * n] & marks[2 * n + 1] for n in range(40))


def test_no_python_in_the_plan(spark):
    plan = winnow.digest(documents(spark, [(1, "a b c d e", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
