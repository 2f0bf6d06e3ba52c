"""The jobs: growing input, a batch that is tried again, reruns, odd rows, the command line, and the SQL on Markdown and on linked pages."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import common, docs_index, link_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sections int, epoch string"
PAGES = "page_id long, url string, html string, status string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, 1, "x") for i, t, lang, source in rows], DOCS)


FIRST = [
    (1, "# One\nA line that says enough.\n## Sub\nSee [two](d2.md) and `Broker.fs` of Delivery.Engine.\n### Deep\nx\n# Two\ny\r\nz", "en", "a"),
    (2, "No heading here, but Delivery.Engine is named.\n\nmore", "en", "a"),
    (3, None, "de", "a"),
    (4, "", None, "b"),
    (5, "## Starts with a heading\n## Empty one\n# Last", "", "b"),
    (None, "without a number", "en", None),
]
LATER = [
    (2, "# Now\nwith a heading and [[d1]] for Delivery.Engine", "en", "a"),
    (3, None, "de", "a"),
    (6, "Delivery.Engine again, `Broker.fs` too.", "fr", "c"),
    (6, "Delivery.Engine again, `Broker.fs` too.", "fr", "c"),
]


def rows_of(df):
    order = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({sorted(map(str, Path(path).rglob('*.parquet')))})")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def test_docs_index_takes_only_what_is_new(spark, tmp_path):
    at = [f"{tmp_path}/{x}" for x in ("documents", "out", "checkpoint")]
    docs_of(spark, FIRST).repartition(3).write.parquet(at[0])
    got = docs_index.run(spark, *at, {"files_per_batch": 1})
    assert rows_of(got) == sql_rows(docs_index.SQL, documents=at[0])
    paths = {r.file_path: r for r in got.collect()}
    assert paths["en/a/d1.md"].heading_path in ("(intro)", "(intro) > One", "(intro) > One > Sub", "(intro) > One > Sub > Deep", "(intro) > Two")
    before = files(f"{at[1]}/sections")

    docs_of(spark, LATER).write.mode("append").parquet(at[0])
    got = docs_index.run(spark, *at, {"files_per_batch": 1})
    now = [r for r in FIRST if r[0] not in (2, 3)] + LATER
    docs_of(spark, now).write.parquet(f"{tmp_path}/as-if")
    assert rows_of(got) == sql_rows(docs_index.SQL, documents=f"{tmp_path}/as-if")
    after = files(f"{at[1]}/sections")
    assert before.items() <= after.items() and len(after) > len(before)
    new = spark.read.parquet(f"{at[1]}/sections").join(spark.read.parquet(f"{at[1]}/sections").agg(F.max("epoch").alias("epoch")), "epoch")
    assert {r.file_path for r in new.select("file_path").collect()} <= {"en/a/d2.md", "fr/c/d6.md"}  # 3 hasn't changed
    gaps = {r.entity: r for r in spark.read.parquet(f"{at[1]}/gaps").collect()}
    assert (gaps["delivery.engine"]["count"], gaps["delivery.engine"].sources, gaps["delivery.engine"].signal) == (3, "d1, d2, d6", "shared")
    assert gaps["broker"]["count"] == 2 and gaps["broker"].total_files == 7

    # Nothing new: the same again, and no new file of sections.
    again = docs_index.run(spark, *at, {"files_per_batch": 1})
    assert rows_of(again) == rows_of(got) and files(f"{at[1]}/sections") == after
    assert {r.entity: r for r in spark.read.parquet(f"{at[1]}/gaps").collect()} == gaps


def test_docs_index_survives_a_batch_that_fails_after_its_write(spark, tmp_path, monkeypatch):
    at = [f"{tmp_path}/{x}" for x in ("documents", "out", "checkpoint")]
    docs_of(spark, FIRST).write.parquet(at[0])
    real, seen = docs_index.indexed, []

    def failing(session, out):
        seen.append(1)
        if len(seen) == 2:  # after the sections are written
            raise RuntimeError("lost")
        return real(session, out)

    monkeypatch.setattr(docs_index, "indexed", failing)
    with pytest.raises(StreamingQueryException):
        docs_index.run(spark, *at)
    assert files(f"{at[1]}/sections")
    got = docs_index.run(spark, *at)
    assert rows_of(got) == sql_rows(docs_index.SQL, documents=at[0])
    assert spark.read.parquet(f"{at[1]}/sections").select("epoch").distinct().count() == 1


def test_docs_index_of_an_empty_table(spark, tmp_path):
    at = [f"{tmp_path}/{x}" for x in ("documents", "out", "checkpoint")]
    docs_of(spark, []).write.parquet(at[0])
    assert docs_index.run(spark, *at).collect() == []
    docs_of(spark, FIRST).write.mode("append").parquet(at[0])
    assert docs_index.run(spark, *at).count() > 6


def test_of_one_path_in_a_batch_the_greatest_text_stands(spark):
    rows = docs_index.as_files(docs_of(spark, [(1, "b", "en", "a"), (1, "a", "en", "a"), (1, None, "en", "a")])).collect()
    assert [(r.file_path, r.content) for r in rows] == [("en/a/d1.md", "b")]


SITE = [
    (1, "https://Site.org/", '<html lang="en"><title>Home &amp; <b>more</b></title><a href="/a/b.html">to  b</a><a href="a/./b.html?utm_x=1#top">again</a><a href="/">me</a><a href="#x">x</a><a href="mailto:a@b">m</a><a href="gone">g</a></html>', "x"),
    (2, "http://site.org/a/b.html?ref=q", """<a href='../'>up</a><!-- <a href="/hidden">h</a> --><script>'<a href="/no">n</a>'</script><A class=k HREF="c?x=1&amp;y=2"
 >c</A><a href="//other.net/z">o</a>""", "x"),
    (3, "https://site.org/a/c?x=1&utm_source=f&y=2", '<html lang="de"><a href="?x=2">q</a><a href="ftp://site.org/">f</a></html>', None),
    (4, "https://site.org/a/b.html/", None, None),
    (5, None, '<html lang=""><a href="/a">rel</a><a href="https://site.org/a/c?x=1&y=2">abs</a></html>', None),
    (6, "not a url", "", None),
    (7, "https://lone.site.org", "<a href='https://lone.site.org/'>self</a><a href='../../..'>up</a>", None),
    (7, "https://lone.site.org", "<a href='https://lone.site.org/'>self</a><a href='../../..'>up</a>", None),
    (None, "https://site.org/null", "<a href='a/c?y=2'>r</a>", None),
]


def test_link_audit_of_a_site(spark, tmp_path):
    spark.createDataFrame(SITE, PAGES).write.parquet(f"{tmp_path}/pages")
    got = link_audit.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out")
    assert rows_of(got) == sql_rows(link_audit.SQL, pages=f"{tmp_path}/pages")
    by = {r.page_id: r for r in got.collect()}
    home, b, c = by[1], by[2], by[3]
    assert (home.address, home.title, home.links, home.ok, home.broken, home.external, home.backlinks, home.orphan) == ("site.org/", "Home &amp; more", 6, 3, 1, 0, 1, False)
    assert (b.address, b.links, b.ok, b.external, b.backlinks, b.same_address) == ("site.org/a/b.html", 3, 2, 1, 1, 2)
    assert (c.address, c.backlinks, c.lang, c.broken, c.ok) == ("site.org/a/c?x=1&y=2", 2, "de", 1, 0)
    assert by[4].backlinks == 1 and not by[4].orphan and by[4].links == 0
    assert by[5].address is None and by[5].orphan and by[5].ok == 1 and by[6].orphan and by[6].same_address == 1
    assert by[7].orphan and by[7].ok == 4 and by[7].backlinks == 0 and by[None].broken == 1
    links = spark.read.parquet(f"{tmp_path}/out/links")
    assert {r.status: r["count"] for r in links.groupBy("status").count().collect()} == {"ok": 3 + 2 + 1 + 4, "broken": 1 + 1 + 1, "external": 1, "anchor": 1, "other": 1 + 1 + 1}
    again = link_audit.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out")
    assert rows_of(again) == sql_rows(link_audit.SQL, pages=f"{tmp_path}/pages")
    own = link_audit.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out2", {"own_hosts": ["Other.net"], "tracking": []})
    assert {r.page_id: r.broken for r in own.collect()}[2] == 2  # with ref=q the page has another address


def test_link_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages")
    assert link_audit.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out").collect() == []


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"sample": 2}')
    assert common.configured(spark, str(tmp_path / "c.json"), docs_index.DEFAULTS) == docs_index.DEFAULTS | {"sample": 2}
    (tmp_path / "d.json").write_text('{"smaple": 2}')
    with pytest.raises(ValueError, match="smaple"):
        common.configured(spark, str(tmp_path / "d.json"), docs_index.DEFAULTS)
    for job in ("docs_index", "link_audit"):
        at = Path(common.__file__).parent / f"{job}.json"
        assert common.configured(spark, str(at), __import__(f"jobs.{job}", fromlist=["x"]).DEFAULTS)


def test_settings_are_left_as_they_were(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    at = [f"{tmp_path}/{x}" for x in ("documents", "out", "checkpoint")]
    docs_of(spark, FIRST[:1]).write.parquet(at[0])
    docs_index.run(spark, *at)
    assert before == {k: spark.conf.get(k) for k in before} and not spark.streams.active


def test_command_lines(spark, tmp_path):
    docs_of(spark, FIRST).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(SITE, PAGES).write.parquet(f"{tmp_path}/pages")
    top = Path(common.__file__).parent.parent
    for job, *args in (("docs_index", "--documents", f"{tmp_path}/documents", "--checkpoint", f"{tmp_path}/c", "--out", f"{tmp_path}/d"), ("link_audit", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/l")):
        run = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", f"jobs/{job}.json"], cwd=top, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
        assert re.search(r"jobs wrote .*partitioned by", run.stderr) and re.search(r"jobs read \d+", run.stderr)
    assert spark.read.parquet(f"{tmp_path}/d/sections").count() > 6 and spark.read.parquet(f"{tmp_path}/l/pages").count() == 8


def test_jobs_need_nothing_of_the_text_subpackage():
    for p in [*Path(common.__file__).parent.glob("*.py"), Path(__file__)]:
        assert not re.search(r"^\s*(from|import)\s+(sextant\.llm|corpus_pipeline)", p.read_text(), re.M)
