import math
import random
import re
import zlib

import numpy as np

from brindle.llm import kernels, quality, queries, toxicity

from .fixtures import AWKWARD, documents

DATA = "/root/testdata/sf0.01"


def test_toxicity_on_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    told = [(r.toxic, labels[r.doc_id] == 1) for r in got if r.doc_id in labels]
    assert sum(a and b for a, b in told) >= 0.9 * sum(b for _, b in told)
    assert sum(a and not b for a, b in told) <= 0.01 * len(told)
    assert all(0 <= r.expected_severity <= 2 and r.grade in (0, 1, 2) for r in got)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 3 = 0").collect()}
    got = [(r.toxic, truth[r.doc_id]) for r in toxicity.severities(docs, model).collect() if r.doc_id in truth]
    assert sum(a == bool(b) for a, b in got) / len(got) >= 0.95


def test_ordinal_grades(spark):
    words = ["calm", "rude", "vile"]
    rows = [(n, f"text {n % 7} {words[n % 3]} more", "s") for n in range(90)]
    labels = spark.createDataFrame([(n, n % 3) for n in range(90)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    assert {r.doc_id: r.grade for r in toxicity.severities(documents(spark, rows), model).collect()} == {n: n % 3 for n in range(90)}


def test_awkward_rows_and_no_labels(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r.expected_severity for r in toxicity.severities(docs, toxicity.train(docs, none)).collect()} == {0.0}
    some = spark.createDataFrame([(6, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.severities(docs, toxicity.train(docs, some)).count() == len(AWKWARD)
    marks = spark.createDataFrame([(6, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.scores(docs, quality.train(docs, marks)).collect()} == {0.5}
    marks = spark.createDataFrame([(n, n % 2) for n in range(10)], "doc_id long, quality int")
    got = quality.scores(docs, quality.train(docs, marks)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.scores(documents(spark, []), quality.train(docs, marks)).count() == 0


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = queries.op10_quality_classifier(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95


def _sample_texts():
    rng = random.Random(4)
    words = ["river", "stone", "engine", "letter", "garden", "market", "signal", "copper", "winter", "planet"]
    plain = [" ".join(rng.choices(words, k=rng.randrange(3, 40))).capitalize() + "." for _ in range(60)]
    odd = [" ".join(rng.choice(words).upper() + "!" * rng.randrange(1, 4) for _ in range(rng.randrange(2, 30))) for _ in range(60)]
    return [t.encode() for t in plain + odd]


def test_votes_match_brute_force():
    texts = _sample_texts()
    labels = np.array([1.0] * 60 + [0.0] * 60)
    shares = np.concatenate(list(quality.term_shares(texts)))
    model = quality.fit(shares[::2], labels[::2])
    x = model.embed(shares).astype(float)
    for n, got in enumerate(model.vote(shares, block=7)):
        cosine = np.round([sum(a * b for a, b in zip(x[n], v)) for v in model.vectors.astype(float)], 6)
        best = sorted(range(60), key=lambda k: (-cosine[k], k))[: model.neighbours]
        weight = np.maximum(cosine[best], 0)
        assert abs(got - (weight * model.labels[best]).sum() / weight.sum()) < 1e-5
    assert quality.NeighbourModel(model.idf, model.projection, model.vectors[:0], model.labels[:0], 15).vote(shares[:3]).tolist() == [0.5] * 3


def test_words_count_not_their_looks_alone():
    a, b = (next(quality.term_shares([t])) for t in (b"The quick brown fox jumps.", b"Buy cheap white pills today."))
    assert (a[:, : quality.SHAPES] == b[:, : quality.SHAPES]).all() and (a != b).any()


def test_a_labelled_id_with_several_texts_is_one_row(spark):
    docs = documents(spark, [(1, f"text {n}", "s") for n in range(50)] + [(2, "other", "s")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 10, "doc_id", "text").collect()
    assert sorted((r.id, r.label) for r in rows) == [(1, 1), (2, 0)]


def test_severities_match_brute_force(spark):
    """Four grades: severities and grades again from the fitted weights, word by word."""
    levels = ["calm", "rude", "nasty", "vile"]
    rng = random.Random(6)
    rows = [(n, " ".join([*rng.choices(["one", "two", "three", "four"], k=rng.randrange(0, 9)), *levels[1 : n % 4 + 1]]), "s") for n in range(160)]
    labels = spark.createDataFrame([(n, n % 4) for n in range(160)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) >= 0).all()
    more = rows + [(900, None, "s"), (901, "", "s"), (902, "VILE, vile; Rude", "s")]
    got = {r.doc_id: r for r in toxicity.severities(documents(spark, more), model).collect()}
    for i, text, _ in more:
        held = set()
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            full, _, _, start = kernels.hash_words(word, bare=True, prefix=toxicity.PREFIX)
            held |= {int(full[0]) % toxicity.BINS, int(start[0]) % toxicity.BINS + toxicity.BINS}
        margin = sum(model.weights[h] for h in held)
        above = [1 / (1 + math.exp(t - margin)) for t in model.thresholds]
        cells = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert abs(got[i].expected_severity - sum(above)) < 1e-9
        assert got[i].grade == cells.index(max(cells)) and got[i].toxic == (above[0] >= 0.5)
    assert sum(got[n].grade == n % 4 for n in range(160)) > 150


def test_two_labels_give_one_threshold(spark):
    rows = [(n, f"text {n % 7} {'vile' if n % 3 == 0 else 'calm'} more", "s") for n in range(90)]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(90)], "doc_id long, toxic int"))
    assert len(model.thresholds) == 1
    assert {r.doc_id: r.grade for r in toxicity.severities(documents(spark, rows), model).collect()} == {n: int(n % 3 == 0) for n in range(90)}
