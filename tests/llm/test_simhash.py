import random

import numpy as np
import xxhash

from brindle.llm import queries, simhash

from .fixtures import AWKWARD, DATA, documents


def brute_print(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            best[top(n)] = min(best.get(top(n), i), i)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((i, f"{p:016x}", best.get(top(n))) for n, ((i, _), p) in enumerate(zip(rows, prints))), key=key)


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == brute_groups(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(queries.op6_simhash_near_dedup(spark, DATA).collect(), rows)


def test_awkward_rows(spark):
    check(simhash.near_duplicates(documents(spark, AWKWARD)).collect(), [(i, t) for i, t, _ in AWKWARD])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from brindle.llm.components import connected_components

    group = {x: x for x in signed}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if (prints[i] ^ int(np.int64(b).astype(np.uint64))).bit_count() <= 3:
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    want = {x: top(x) for x in signed}
    for most in (4096, 3):  # 3: most buckets are cut into blocks
        got = {r.node: r.label for r in connected_components(simhash.fingerprint_links(df, most)).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_a_bucket_that_outgrows_its_task_streams_through():
    import pyarrow as pa

    rows = [(1, 8), (1, 9)] + [(5, 100 + n) for n in range(50)] + [(6, 16), (6, 17), (7, 1)]
    for size in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "fp": [f for _, f in part]}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        out = [r for b in simhash._links_of_sorted(iter(batches), 10) for r in b.to_pylist()]
        assert sorted(r["a"] for r in out if r["key"] == 5) == [100 + n for n in range(50)]
        assert {(r["a"], r["b"]) for r in out if r["key"] is None} == {(8, 9), (16, 17)}
