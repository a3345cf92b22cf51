import corpus_pipeline as P
from brindle.llm import lines, quality

from .fixtures import documents
from .test_decontaminate import brute as brute_leaks
from .test_lines_and_mixing import brute_lines, check_mix
from .test_similar import brute_similar

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())
    kept = []
    for name, stage in P.STAGES:
        before = rows(docs) if name != "quality" else None
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert new.columns == docs.columns
        if name == "quality":
            scores = quality.scores(docs, quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in scores if r.predicted}
        elif name == "line_dedup":
            assert [(d, t) for d, t, _ in rows(new)] == sorted((d, t) for d, _, _, t in brute_lines(before, lines.MIN_SITES))
            assert all(r.n_chars == len(r.text) for r in new.collect())
        elif name == "near_dedup":
            assert [d for d, _, _ in rows(new)] == [d for d, c in brute_similar([(d, t) for d, t, _ in before]) if d == c]
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            gone = {d for d, _, _ in before} - {d for d, _, _ in rows(new)}
            some = [(d, t) for d, t, _ in before if d in gone or d % 10 == 0]
            assert gone == {d for d, _ in brute_leaks(some, items)}
        else:
            check_mix(out.collect(), before)
        kept.append(new.count())
        docs = new
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert P.run(spark, DATA).count() == kept[-1]


def test_near_dedup_keeps_null_ids_and_ids_with_two_texts(spark):
    x, y, z = (" ".join(f"{w}{n}" for n in range(30)) for w in "xyz")
    rows = [(3, y), (5, x), (5, y), (None, z), (None, "no copy of this text is here"), (None, x), (None, z.upper()), (7, ""), (None, None), (8, "one"), (8, "one")]
    kept = P.keep_one_of_each_group(spark, documents(spark, [(i, t, "a") for i, t in rows]), DATA)
    assert kept.columns == list(P.COLUMNS)
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(3, y), (5, x), (None, z), (None, "no copy of this text is here"), (7, ""), (8, "one")], key=repr)
