"""Builds by change sets against full builds."""

from pyspark.sql import functions as F

from brindle.operators import corpus, incremental
from brindle.plans import incremental as plans


def test_three_rounds_equal_full_builds_and_touch_only_changes(spark, monkeypatch):
    long = " ".join(f"Sentence {n} of a long text says a few words." for n in range(120))
    base = {n: f"Text {n}. Mail m{n}@x.example" for n in range(30)} | {100: long, 101: None, 102: ""}
    snapshots = [dict(base)]
    for n in (1, 2, 3):
        now = dict(snapshots[-1])
        now.pop(n)
        now[n + 10] = f"{now[n + 10]} edited {n}"
        now[200 + n] = f"new in {n}"
        now[100] = long + f" More of round {n}."
        if n == 3:
            now[1] = "back again"
        snapshots.append(now)
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    seen, plain = [], corpus.chunks
    monkeypatch.setattr(corpus, "chunks", lambda docs, *a, **k: seen.append(docs.count()) or plain(docs, *a, **k))
    marks, records = (x.checkpoint() for x in incremental.full_build(frame(snapshots[0])))
    for n in (1, 2, 3):
        marks, records, changes = incremental.next_build(marks, records, frame(snapshots[n]))
        marks, records = marks.checkpoint(), records.checkpoint()
        kinds = {r.kind: r.n for r in changes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        assert (kinds["new"], kinds["changed"], kinds["gone"]) == (1 + (n == 3), 2, 1)
        assert seen[-1] == 3 + (n == 3)  # only what is new or changed is cut
        want = incremental.full_build(frame(snapshots[n]))[1].drop("version")
        assert sorted(map(tuple, records.drop("version").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    versions = {r.record_id: r.version for r in records.collect()}
    assert versions["11:0"] == versions["13:0"] == "1.1" and versions["1:0"] == "1.0" and versions["20:0"] == "1.0"
    assert versions["100:0"] == "1.0" and max(v for i, v in versions.items() if i.startswith("100:")) == "1.3"  # only the last chunk changed


def test_records_take_one_pass_over_documents_dealt_out(spark, capsys):
    docs = spark.createDataFrame([(n, f"Text {n}. Mail m{n}@x.example") for n in range(50)] + [(50, None)], "doc_id long, text string").coalesce(1)
    made = incremental.records_of(docs)
    made.explain()
    assert "Join" not in capsys.readouterr().out  # the scan's findings stay in their chunk's row
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.record_id: (r.doc_id, r.chunk, r.has_pii, r.redacted) for r in made.collect()}
    assert got == {f"{n}:0": (n, 0, True, f"Text {n}. Mail [EMAIL_REDACTED]") for n in range(50)}


def test_change_sets_make_no_records(spark, monkeypatch):
    monkeypatch.setattr(corpus, "chunks", lambda *a, **k: 1 / 0)
    rows = plans.change_sets(spark, "/root/testdata/sf0.001").collect()
    assert {r["round"] for r in rows} == {1, 2, 3} and {r["kind"] for r in rows} == set(incremental.KINDS)


def test_scan_carries_other_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example", "x", 7), (2, None, None, None), (3, "account no: 123456789012 and +91 98765 43210", "y", 9)], "doc_id long, text string, kinds2 string, held long")
    plain, carried = corpus.scan_personal_data(docs), corpus.scan_personal_data(docs, keep=("kinds2", "held"))
    assert carried.columns == [*plain.columns, "kinds2", "held"]
    assert sorted(map(tuple, carried.drop("kinds2", "held").collect())) == sorted(map(tuple, plain.collect()))
    assert {r.doc_id: (r.kinds2, r.held) for r in carried.collect()} == {1: ("x", 7), 2: (None, None), 3: ("y", 9)}
