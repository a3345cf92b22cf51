"""Readers, sinks and addresses that the query tests do not reach."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.operators import search
from brindle.sources import files, web
from brindle.streaming import nudges


def test_addresses(spark):
    base = "https://h.org/a/b/page.html?x=1#top"
    cases = {
        "c.html": "https://h.org/a/b/c.html", "./c.html": "https://h.org/a/b/c.html", "../c.html": "https://h.org/a/c.html", "../../../c.html": "https://h.org/c.html",
        "/c/../d?q=1#z": "https://h.org/d?q=1", "//k.org/x": "https://k.org/x", "http://k.org": "http://k.org/", "?y=2": "https://h.org/a/b/page.html?y=2", "#top": None, "mailto:a@b.c": None,
        "javascript:void(0)": None, "": None,
    }
    rows = spark.createDataFrame([(h, base) for h in cases], "href string, base string")
    got = {r.href: r.url for r in rows.select("href", web.resolved(F.col("href"), F.col("base")).alias("url")).collect()}
    assert got == cases


def test_links_of_a_host_in_order(spark):
    html = """<a href="../z.pdf">z</a><a class=x href='b/'>b</a><A HREF="https://h.org/a">a</A><a href="https://k.org/">k</a><a href="/skip/me">s</a><a href="b">b again</a>"""
    rows = web.resolved_links(spark.createDataFrame([("https://h.org/d/e", html.replace("A HREF", "a href"))], "url string, html string"), exclude="/skip/")
    assert [(r.url, r.is_pdf) for r in rows.collect()] == [("https://h.org/a", False), ("https://h.org/d/b", False), ("https://h.org/z.pdf", True)]


def test_pdf_files_by_their_first_bytes(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"<html>", "c.pdf": b"", "d.bin": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    assert sorted(Path(r.path).name for r in files.pdf_bytes(spark, str(tmp_path)).collect()) == ["a.pdf", "d.bin"]


def test_sources_by_their_registry(spark, tmp_path):
    (tmp_path / "fees.csv").write_text("name,fee\nA,1\nB,\n , 3 \n")
    (tmp_path / "leads.csv").write_text("who\nx\n")
    (tmp_path / "book.md").write_text("# Title  \n\n \n\n  many   blanks\there \t\n")
    (tmp_path / "lines.jsonl").write_text('{"doc_id": "j1", "title": "J", "text": "one"}\n\n{"doc_id": "j2", "title": "K", "text": "two"}\n')
    (tmp_path / "pricing.txt").write_text("page one\npage two")
    entries = [
        {"id": "fees", "kind": "csv", "path": "fees.csv"}, {"id": "leads", "kind": "csv_pii", "path": "leads.csv", "title": "Leads", "market": "PH"}, {"id": "book", "kind": "markdown", "path": "book.md"},
        {"id": "lines", "kind": "jsonl", "path": "lines.jsonl"}, {"id": "pricing", "kind": "pdf_text", "path": "pricing.txt"}, {"id": "none", "kind": "csv", "path": "missing.csv"},
    ]
    for e in entries:
        e["path"] = str(tmp_path / e["path"])
    got = {r.doc_id: (r.source_type, r.market, r.text) for r in files.read_sources(spark, entries).collect()}
    assert got == {
        "fees": ("internal_table", "IN", "## fees\n| name: A; fee: 1\n| name: B\n| fee: 3"), "leads": ("crm_export", "PH", "## Leads\n| who: x"),
        "book": ("internal_handbook", "IN", "# Title\n\nmany blanks here"), "j1": ("jsonl", "IN", "one"), "j2": ("jsonl", "IN", "two"), "pricing": ("internal_pdf", "IN", "page one\npage two"),
    }
    with pytest.raises(ValueError, match="unknown kind"):
        files.read_sources(spark, [{"id": "x", "kind": "xls", "path": str(tmp_path / "book.md")}])


def test_snapshots_are_not_overwritten(spark, tmp_path):
    records = spark.range(3)
    files.write_snapshot(records, str(tmp_path), "v1")
    assert spark.read.parquet(f"{tmp_path}/versions/v1").count() == 3
    with pytest.raises(Exception, match="already exists"):
        files.write_snapshot(records, str(tmp_path), "v1")


def test_point_reads_open_one_folder(spark, tmp_path):
    files.write_records(spark.range(500).select(F.col("id").cast("string").alias("record_id")), str(tmp_path / "index"))
    found = files.read_records(spark, str(tmp_path / "index"), ["7"])
    assert [r.record_id for r in found.collect()] == ["7"] and len({re.search("bucket=[0-9]+", f)[0] for f in found.inputFiles()}) <= files.BUCKETS
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString() or "PartitionFilters" in found._jdf.queryExecution().toString()


def test_robots_grammar(spark):
    text = "User-agent: a\r\nUser-agent: Bot # us\nDisallow: /p\nAllow: /p/open\nDisallow: /*.pdf$\nDisallow: /x(1)\nAllow: /t\nDisallow: /t\n\nUser-agent: *\nDisallow: /\n"
    robots = spark.createDataFrame([("h", text), ("open", None), ("star", "USER-AGENT: *\ndisallow: /a*b\n"), ("free", "User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /")], "host string, text string")
    want = {
        ("h", "/q"): True, ("h", "/p"): False, ("h", "/p/open/1"): True, ("h", "/p/other"): False, ("h", "/d/f.pdf"): False, ("h", "/d/f.pdfx"): True, ("h", "/x(1)"): False, ("h", "/x1"): True,
        ("h", "/t"): True, ("open", "/p"): True, ("star", "/acb/d"): False, ("star", "/ba"): True, ("free", "/p"): True, ("nowhere", "/p"): True,
    }
    urls = spark.createDataFrame(list(want), "host string, path string")
    got = {(r.host, r.path): r.allowed for r in web.judged(urls, web.robots_rules(robots, "bot")).collect()}
    assert got == want


def test_each_sink_takes_each_batch_once(spark, tmp_path):
    """One sink fails twice, one after it has written, one for good; a later call goes on where each stands."""
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = {"shaky": 0, "late": 0}
    good = {name: nudges.numbered_parquet(str(tmp_path / name)) for name in ("plain", "shaky", "late", "broken")}

    def shaky(batch, number):
        counts["shaky"] += 1
        if counts["shaky"] <= 2:
            raise RuntimeError("not yet")
        good["shaky"](batch, number)

    def late(batch, number):
        good["late"](batch, number)
        counts["late"] += 1
        if counts["late"] == 1:
            raise RuntimeError("after it has written")

    def broken(batch, number):
        raise RuntimeError("no dashboard")

    sinks = {"plain": good["plain"], "shaky": shaky, "late": late, "broken": broken}
    failed = nudges.fan_out(stream, sinks, str(tmp_path / "state"))
    assert set(failed) == {"broken"} and "no dashboard" in failed["broken"]
    for name in ("plain", "shaky", "late"):
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(30))
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert nudges.fan_out(stream, {**sinks, "broken": good["broken"]}, str(tmp_path / "state")) == {}  # a restart with the sink mended
    for name in good:
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(40))


def test_blocked_records_and_filters(spark):
    docs = [
        (1, "apple pie recipe", "en", "faq", "IN", "", True), (2, "apple pie recipe", "en", "faq", "IN", "", False), (3, "apple tart", "fr", "faq", "", "loan", True),
        (4, "apple cake", "en", "policy", "PH", "lease", True), (5, "apple crumble", "en", "faq", None, "lease", True),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, language string, category string, market string, product string, retrieval_allowed boolean")
    asks = [(1, None, None, None, None), (2, "en", "IN", None, None), (3, "", "", ["faq"], "loan"), (4, None, "PH", ["policy", "faq"], "lease"), (5, "de", None, None, None)]
    q = spark.createDataFrame([(i, "apple", *a) for i, *a in asks], "q_id long, question string, q_language string, q_market string, q_categories array<string>, q_product string")
    got = {}
    for r in search.search(df, q, k=10).collect():
        got.setdefault(r.q_id, set()).add(r.doc_id)
    assert got == {1: {1, 3, 4, 5}, 2: {1, 5}, 3: {1, 3}, 4: {4}}
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 6)], "doc_id long, embedding array<double>")
    near = search.search(df, q.withColumn("q_vector", F.array(F.lit(1.0), F.lit(0.2))), vectors, k=10).collect()
    assert {(r.q_id, r.doc_id) for r in near} == {(i, d) for i, ds in got.items() for d in ds}
