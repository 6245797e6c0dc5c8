from tests.test_sources import DUMP
from weftline.__main__ import main


def read(spark, path):
    return sorted(r["value"] for r in spark.read.text(str(path)).collect())


def test_from_dump_to_senses(spark, tmp_path):
    at = lambda *names: str(tmp_path.joinpath(*names))
    (tmp_path / "dump.xml").write_text(DUMP)
    (tmp_path / "r.tsv").write_text("Bus_stop\tStop\n")
    assert main([], spark) == 2 and main(["process", at("dump.xml"), at("d")], spark) == 0
    main(["lemmatize", at("d", "links"), at("lem"), at("r.tsv")], spark)
    assert read(spark, at("lem")) == ["A stop is here.\tstop@@Stop@2:6", "See the stop and tram too.\ttram@@Tram@17:21"]
    main(["wordcount", at("d", "links"), at("wc")], spark)
    assert read(spark, at("wc")) == ["stop\t1", "tram\t1"]
    main(["dictionary", at("lem"), at("dict")], spark)
    main(["senses", at("dict"), at("senses"), "10"], spark)
    assert read(spark, at("dict")) == ["stop@@Stop\t1", "tram@@Tram\t1"] and read(spark, at("senses")) == ["stop\t1\t1\tStop:1  ", "tram\t1\t1\tTram:1  "]
    main(["whitelist", at("lem"), at("w"), "tram, x"], spark)
    main(["first", at("lem"), at("f")], spark)
    assert len(read(spark, at("w"))) == 1 and len(read(spark, at("f"))) == 2
    (tmp_path / "words.txt").write_text("tram\n")
    main(["bytext", at("d", "links"), at("b"), at("words.txt")], spark)
    assert read(spark, at("b")) == ["See the stop and tram too.\tTram@17:21"]
    main(["tokenize", at("f"), at("t")], spark)
    assert read(spark, at("t"))[0] == "stop\tStop\ta stop be here ."


def test_lists_samples_and_evaluation(spark, tmp_path):
    at = lambda *names: str(tmp_path.joinpath(*names))
    (tmp_path / "l.tsv").write_text("".join(f"s{k}\tw@@T{k % 2}@0:1\n" for k in range(40)))
    main(["sample", at("l.tsv"), at("s")], spark)
    rows = read(spark, at("s"))
    assert len(rows) == 11 and sum(r.startswith("w@@T0\t") for r in rows) == sum(r.startswith("w@@T1\t") for r in rows) == 3
    (tmp_path / "words.tsv").write_text("top\t9\nmid\t5\nRare\t1\n")
    (tmp_path / "samples.tsv").write_text("mid@@x\ts\tl\ntop\ts\tl\nmid\ts2\tl\n")
    main(["midfrequency", at("words.tsv"), at("samples.tsv"), at("m"), "2", "1"], spark)
    assert read(spark, at("m", "words")) == ["mid\t5"] and len(read(spark, at("m", "samples"))) == 2
    main(["wordlist", at("words.tsv"), at("wl"), "1", "5"], spark)
    main(["lines", at("words.tsv"), at("n"), "2"], spark)
    assert read(spark, at("wl")) == ["mid\t5"] and len(read(spark, at("n"))) == 2
    (tmp_path / "m.tsv").write_text("a\tA\ts\nb\tOld\ts\nc\tA#x\ts\n")
    (tmp_path / "p.txt").write_text("A\nB\nOld\n")
    (tmp_path / "r.tsv").write_text("Old\tA#y\n")
    main(["inlinks", at("m.tsv"), at("h"), at("r.tsv")], spark)
    main(["statistics", at("m.tsv"), at("p.txt"), at("r.tsv"), at("st")], spark)
    assert read(spark, at("h")) == ["3\t1"] and read(spark, at("st", "inlink-histogram")) == ["0\t1", "3\t1"] and read(spark, at("st", "redirects")) == ["A\t1"]
    for fold in "ab":
        (tmp_path / f"e-{fold}.tsv").write_text("w\t1\tX\nw\t2\tY\nw\t\tX\n")
    main(["evaluate", at("e-*.tsv"), at("ev")], spark)
    assert read(spark, at("ev", "metrics"))[0].split("\t")[:2] == ["6", "6"] and read(spark, at("ev", "baseline")) == ["w\tX:4  Y:2"]
