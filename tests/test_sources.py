import gzip

from pyspark.sql import functions as F

from weftline import streaming
from weftline.config import PipelineConfig
from weftline.sources import readers, writers

DUMP = """<mediawiki>
<page><title>red car</title><ns>0</ns><revision><text>A [[bus stop|stop]] is here. See the stop and [[tram]] too.&lt;ref&gt;x&lt;/ref&gt;</text></revision></page>
<page><title>Talk:x</title><ns>1</ns><revision><text>no</text></revision></page>
<page><title>old car</title><redirect title="red car"/><revision><text>#REDIRECT [[red car]]</text></revision></page>
<page><title>broken</title><ns>0<revision></page>
<page><title>long</title><ns>0</ns><revision><text>%s</text></revision></page>
</mediawiki>""" % ("x" * 300)


def test_dump_to_relations(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    with gzip.open(tmp_path / "dump.xml.gz", "wt") as f:
        f.write(DUMP)
    pages = readers.xml_pages(spark, str(tmp_path / "dump.xml"))
    assert sorted((r["title"], r["ns"], r["redirect"]) for r in pages.collect()) == [("long", 0, None), ("old car", 0, "red car"), ("red car", 0, None)]
    assert readers.xml_pages(spark, str(tmp_path / "dump.xml.gz")).count() == 3
    assert readers.xml_rejects(spark, str(tmp_path / "dump.xml")).cache().count() == 1
    paths = writers.write_dump(pages, str(tmp_path / "out"), PipelineConfig(max_page_length=200))
    read = lambda name: sorted(r["value"] for r in spark.read.text(paths[name]).collect())
    assert read("pages") == ["Long", "Old_car", "Red_car"] and read("redirects") == ["Old_car\tRed_car"]
    assert read("links") == ["A stop is here.\tBus_stop@2:6", "See the stop and tram too.\tTram@17:21"]
    assert read("implicitlinks") == ["A stop is here.\tBus_stop@2:6", "See the stop and tram too.\tTram@17:21  Bus_stop@8:12"]
    again = readers.links(spark, paths["implicitlinks"]).where(F.size("links") == 2).first()
    assert [(x["target"], x["begin"], x["end"]) for x in again["links"]] == [("Tram", 17, 21), ("Bus_stop", 8, 12)]
    assert {r["source"]: r["destination"] for r in readers.redirects(spark, paths["redirects"]).collect()} == {"Old_car": "Red_car"}
    assert writers.write_dump(pages, str(tmp_path / "out"))["pages"].startswith(str(tmp_path / "out1"))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("The\t5\ncat\tx\ndog \t3\t\nbad\nlots\tof\tcolumns\n")
    assert sorted((r["word"], r["cnt"]) for r in readers.word_counts(spark, str(tmp_path / "w.tsv")).collect()) == [("The", 5), ("dog ", 3)]
    (tmp_path / "s.tsv").write_text("a@@b@@c\t4\nd\t1\n")
    assert [tuple(r) for r in readers.sense_counts(spark, str(tmp_path / "s.tsv")).collect()] == [("a", "b@@c", 4)]
    (tmp_path / "r.tsv").write_text("a b\tc d#e\nx\ty\tz\nq\tr#s\n")
    assert sorted(map(tuple, readers.legacy_redirects(spark, str(tmp_path / "r.tsv")).collect())) == [("a_b", "c_d#e"), ("q", "r#s")]
    assert sorted(map(tuple, readers.bare_redirects(spark, str(tmp_path / "r.tsv")).collect())) == [("a b", "c d"), ("q", "r")]
    assert readers.redirects(spark, None).count() == 0
    (tmp_path / "c.tsv").write_text("w\t1\tf:0.5  g:h:2\nv\t2\tf:1\nw\t2\tbad\n")
    words = spark.createDataFrame([("w",)], "word string")
    assert sorted(map(tuple, readers.clusters(spark, str(tmp_path / "c.tsv"), words).collect())) == [("w", "1", "f", 0.5), ("w", "1", "g:h", 2.0)]
    assert {r["fold"] for r in readers.lines(spark, [str(tmp_path / "w.tsv"), str(tmp_path / "r.tsv")]).collect()} == {"w.tsv", "r.tsv"}
    assert readers.word_set(spark, str(tmp_path / "w.tsv")).count() == 5 and readers.page_titles(spark, str(tmp_path / "r.tsv")).count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, [("t", 3), ("u", 1)]), ("a", 1, [])], "lemma string, total long, targets array<struct<target:string,cnt:bigint>>")
    first = writers.write_delimited(df, str(tmp_path / "o"), compression="gzip", single_file=True, order=["lemma"])
    assert [r["value"] for r in spark.read.text(first).collect()] == ["a\t1\t", "b\t2\tt:3  u:1  "]
    assert writers.write_delimited(df, str(tmp_path / "o")) == str(tmp_path / "o1")


def test_settings(spark):
    spark.conf.set("wiki.links.maxperpage", "7")
    try:
        assert PipelineConfig.of(spark).max_links == 7 and PipelineConfig.of(spark, max_links=3).max_links == 3
    finally:
        spark.conf.unset("wiki.links.maxperpage")
    assert PipelineConfig.of(spark).max_links == 1000


def test_stream_of_mentions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "lemma string, target string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("lemma string, target string").parquet(source)
        streaming.surface_form_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("a", "x"), ("c", "z")], "lemma string, target string").write.mode("append").parquet(source)
    counts = streaming.current_counts(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, counts.collect())) == [("a", "x", 3), ("b", "y", 1), ("c", "z", 1)]
