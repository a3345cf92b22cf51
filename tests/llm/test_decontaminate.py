import random
from collections import Counter

import numpy as np

from brindle.llm import decontaminate, queries

from .fixtures import AWKWARD, DATA, documents


def words_of(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ") for w in w.split() if w]


def brute(docs, items):
    """Best weighted similarity of every document and item over all item-sized windows."""
    out = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            if not v or not w:
                continue
            width = min(5, len(v))
            grams = lambda x, width=width: Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))
            own, best = grams(v), 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                got = grams(w[s : s + len(v)])
                total = sum((own | got).values())
                best = max(best, sum((own & got).values()) / total if total else 0.0)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {tuple(v) for _, t in items for v in [words_of(t)[k : k + 5] for k in range(len(words_of(t)) - 4)]}
    near = [(d, t) for d, t in docs if any(tuple(words_of(t)[k : k + 5]) in held for k in range(len(words_of(t)) - 4))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.op2_benchmark_decontamination(spark, DATA).collect()}
    assert got and got == brute(near, items)


def test_edited_and_awkward(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 45, 30, 15, 3, 1])] + [(90, None), (91, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(1000 + i, f"{filler(30)} {t}  {filler(20)}") for i, t in items if t]
    edited = [t.split() for _, t in items[:4]]
    for n, w in enumerate(edited):
        w[0], w[-1] = word(), word().upper()
        docs.append((100 + n, filler(7) + "\n" + " ".join(w) + "\t" + filler(3)))
        docs.append((200 + n, " ".join(w[: len(w) // 2])))
    docs += [(300, items[0][1].upper()), (301, items[3][1][5:])]
    rows = [(i, t, "s") for i, t in docs] + AWKWARD
    df = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, similarity double")
    want = brute([(i, t) for i, t, _ in rows if len(t or "") < 50_000], items)  # the endless ones hold no item
    for batch_words in (1_000_000, 50):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminations(documents(spark, rows), df, batch_words=batch_words).collect()}
        assert got == want and len(got) >= 8
        left = decontaminate.decontaminate(documents(spark, rows), df, batch_words=batch_words)
        assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i or -1 for i, _, _ in rows if i not in {d for d, _ in want})
    assert decontaminate.contaminations(documents(spark, rows), df.limit(0)).count() == 0
    assert decontaminate.contaminations(documents(spark, []), df).count() == 0


def test_the_index_names_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 400, dtype=np.uint64)
    prints = np.concatenate((prints, prints[:100] ^ np.uint64(0b1011), prints[:100] ^ rng.integers(0, 2**22, 100, dtype=np.uint64), prints[:5]))
    index = decontaminate.HammingIndex(prints)
    for one in [*prints[:50], *rng.integers(0, 2**64, 50, dtype=np.uint64)]:
        assert index.near(one).tolist() == np.flatnonzero(np.bitwise_count(prints ^ one) <= decontaminate.RADIUS).tolist()


def test_recall_of_the_radius_just_above_the_threshold():
    """Windows of similarity 0.80 to 0.85 to their item: the radius holds them all but for one in a thousand."""
    rng, missed, tried = np.random.default_rng(5), 0, 0
    for _ in range(4000):
        n = int(rng.integers(10, 400))
        gone = next(g for g in range(n, -1, -1) if (n - g) / (n + g) >= 0.8)  # as many replaced as the threshold allows
        own = rng.integers(0, 2**64, n, dtype=np.uint64)
        window = np.concatenate((own[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)))
        if (n - gone) / (n + gone) > 0.85:
            continue
        a, b = (decontaminate._window_fingerprints(x, np.zeros(1, np.int64), n)[0] for x in (own, window))
        missed, tried = missed + (np.bitwise_count(a ^ b) > decontaminate.RADIUS), tried + 1
    assert tried > 3000 and missed <= tried / 1000


def test_several_batches_of_items(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(12))) for n in range(30)]
    docs = [(n, f"before {items[n][1]} after" if n % 2 else f"clean text number {n}", "s") for n in range(30)]
    df = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contaminations(documents(spark, docs), df).collect()
    parts = decontaminate.contaminations(documents(spark, docs), df, batch_words=40).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 15
    left = decontaminate.decontaminate(documents(spark, docs), df, batch_words=40)
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 30, 2)) and left.columns == documents(spark, docs).columns
