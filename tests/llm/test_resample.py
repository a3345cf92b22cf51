import hashlib
import math
import re
import zlib
from collections import Counter

from brindle.llm import resample

from .fixtures import AWKWARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 500 for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, most=1, least=3, percent=10):
    ours, theirs = Counter(), Counter()
    for _, t in rows:
        ours.update(features(t, most)[1])
    for t in target:
        theirs.update(features(t, most)[1])
    s, t = sum(ours.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log(((theirs[b] + 1) * (s + 500)) / ((n + 1) * (t + 500)))) for b, n in ours.items()}
    out = []
    for i, text in rows:
        n_words, found = features(text, most)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r.append(n)
    return sorted((tuple([*r[:4], r[5] if len(r) > 5 else None]) for r in out), key=repr)


def run(spark, rows, target, **more):
    made = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(documents(spark, rows), made, buckets=500, least_words=3, **more).collect()
    return sorted(map(tuple, got), key=repr)


def test_awkward_rows_against_brute_force(spark):
    rows = AWKWARD + [(100 + n, f"Some words É{n % 7} of ROW {n} and x{n % 13}-y!", "s") for n in range(120)] + [(100, "the same id again", "s")]
    target = ["some words of a target", "row 7 x5 y", None, ""]
    plain = [(i, t) for i, t, _ in rows]
    assert run(spark, rows, target) == brute(plain, target)
    assert run(spark, rows, target, most_words=3, percent=50) == brute(plain, target, 3, percent=50)


def test_small_tables(spark):
    assert run(spark, [], ["a b"]) == []
    rows = [(1, "a b c d", "s"), (2, None, "s"), (3, "a b c", "s")]
    assert run(spark, rows, [], percent=100) == brute([r[:2] for r in rows], [], percent=100)
    assert all(r[4] is None for r in run(spark, [(2, None, "s"), (None, "a", "s")], ["a"], percent=100))
