import random
import re

import numpy as np

from brindle.llm import similar

from .fixtures import AWKWARD, DATA, documents


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_similar(rows, least=0.8):
    """Sorted (doc_id, smallest id of the group) of rows with an id, comparing every pair that shares a shingle."""
    rows = [r for r in rows if r[0] is not None]
    sets, seen = {}, {}
    for _, text in rows:
        sets.setdefault(frozenset(shingles(text)), len(sets))
    keys = list(sets)
    group = list(range(len(keys)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, own in enumerate(keys):
        shared = {}
        for s in own:
            for j in seen.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            seen[s].append(i)
        for j, n in shared.items():
            if n >= least * (len(own) + len(keys[j]) - n):
                lo, hi = sorted((top(i), top(j)))
                group[hi] = lo
    best = {}
    at = [top(sets[frozenset(shingles(t))]) for _, t in rows]
    for (i, _), g in zip(rows, at):
        best[g] = min(best.get(g, i), i)
    return sorted((i, best[g]) for (i, _), g in zip(rows, at))


def got(df):
    return sorted((r.doc_id, r.component_id) for r in df.collect())


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(similar.similar_groups(table)) == brute_similar([(r.doc_id, r.text) for r in table.collect()])


def test_edited_copies(spark):
    """Copies at every distance around the threshold, in chains and in one large group."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for size in (6, 12, 40, 200, 700):
        for _ in range(6):
            text = [word() for _ in range(size)]
            for _ in range(12):
                texts.append(" ".join(text))
                for _ in range(max(1, round(size * rng.choice((0, 0.01, 0.02, 0.04, 0.06))))):
                    text[rng.randrange(len(text))] = word()
                if rng.random() < 0.3:
                    text = text[: -max(1, size // 12)] + [word()]
    base = [word() for _ in range(120)]
    for n in range(600):  # one group of many texts, each unlike the others in one word
        copy = list(base)
        copy[n % 120] = f"w{n}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(9000, texts[0]), (9001, " " + texts[0].upper() + "\n")]
    rng.shuffle(rows)
    table, expected = documents(spark, [(i, t, "a") for i, t in rows]), brute_similar(rows)
    assert got(similar.similar_groups(table)) == expected
    assert got(similar.similar_groups(table, members=16, shingles=3000)) == expected


def test_a_large_group_of_which_few_pairs_are_similar(spark):
    """Texts of one template, most pairs just below the threshold: buckets stay mixed and are cut into blocks."""
    rng = random.Random(8)
    base = [f"base{n}" for n in range(60)]
    texts = []
    for n in range(400):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice((1, 1, 2, 2))):
            copy[at] = f"w{rng.randrange(40)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    expected = brute_similar(rows)
    assert 1 < len({c for _, c in expected}) < 400
    table = documents(spark, [(i, t, "a") for i, t in rows])
    assert got(similar.similar_groups(table)) == expected
    assert got(similar.similar_groups(table, members=30)) == expected


def test_awkward_rows(spark):
    assert got(similar.similar_groups(documents(spark, AWKWARD))) == brute_similar([(i, t) for i, t, _ in AWKWARD])
    assert similar.similar_groups(documents(spark, [])).count() == 0


def test_ring_keeps_all_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, (3000, 4))
    flips = np.zeros((3000, 256), np.uint8)
    for row, n in zip(flips, rng.integers(60, 100, 3000)):
        row[rng.permutation(256)[:n]] = 1
    y = x ^ np.packbits(flips, axis=1, bitorder="little").view(np.int64)
    assert (similar.near_prints(x, y) == (flips.sum(axis=1) <= similar.RADIUS)).all()
