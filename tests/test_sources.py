"""Readers, writers, settings and the file jobs on temporary files."""

import pytest
from pyspark.sql import functions as F

from lexiloom.config import KeywordSettings
from lexiloom.functions.text import LATIN
from lexiloom.plans import jobs
from lexiloom.runtime import materialize
from lexiloom.sources import readers, sinks


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(5000)), encoding="utf-8")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = readers.scan_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 10000
    assert all(int(r["line"][1:]) + 1 == r["line_no"] and f"{r['line'][0]}.txt" in r["path"] for r in rows)


def test_key_value(spark, tmp_path):
    path = tmp_path / "kv"
    path.write_text("k|a,b\nk|a|b\nk\n", encoding="utf-8")
    good, bad = readers.parse_key_value(spark.read.text(str(path)))
    assert [(r["key"], r["words"]) for r in good.collect()] == [("k", ["a", "b"])] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.scan_key_value(spark, str(path))


def test_labelled(spark, tmp_path):
    path = tmp_path / "l"
    path.write_text("L|^|some text\n", encoding="utf-8")
    assert [tuple(r)[1:] for r in readers.scan_labelled(spark, str(path), "|^|").collect()] == [("L", "some text")]
    path.write_text("L\tsome text\n", encoding="utf-8")
    assert [tuple(r)[1:] for r in readers.scan_labelled(spark, str(path)).collect()] == [("L", "some text")]


def test_ratings(spark, tmp_path):
    path = tmp_path / "r"
    path.write_text('id\tdocument\tlabel\n1\t가나 "x"\t1\n2\tabc\t0\n', encoding="utf-8")
    assert [tuple(r) for r in readers.scan_ratings(spark, str(path)).collect()] == [("1", "가나 ", 1)]
    latin = readers.scan_ratings(spark, str(path), LATIN).collect()
    assert {r["id"]: r["text"] for r in latin} == {"1": " x", "2": "abc"}


def test_encoding_and_class_files(spark, tmp_path):
    (tmp_path / "neg").write_bytes(b"caf\xe9 (x)\n")
    (tmp_path / "pos").write_bytes(b"fine\n")
    line = readers.scan_lines(spark, str(tmp_path / "neg"), "ISO-8859-1").first()["line"]
    assert line == "café (x)"
    rows = readers.scan_class_files(spark, {str(tmp_path / "neg"): 1, str(tmp_path / "pos"): 0}).collect()
    assert {(r["text"], r["label"]) for r in rows} == {(r"caf \( x \)", 1), ("fine", 0)}


def test_parallel(spark, tmp_path):
    (tmp_path / "s").write_text("a\nb\nc\n", encoding="utf-8")
    (tmp_path / "t").write_text("x\ny\nz\n", encoding="utf-8")
    pair = (str(tmp_path / "s"), str(tmp_path / "t"))
    rows = sorted(tuple(r) for r in readers.scan_parallel(spark, *pair).collect())
    assert rows == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert readers.scan_parallel(spark, *pair, drop_last=True).count() == 2


def test_parallel_folders_of_several_files(spark, tmp_path):
    rows = [(i, f"s{i}" if i % 3 else "", None if i == 4 else f"t{i}\nx") for i in range(23)]
    pairs = spark.createDataFrame(rows, "k int, src string, dst string").repartition(5)
    sides = (str(tmp_path / "a"), str(tmp_path / "b"))
    sinks.write_parallel(pairs, ["k"], *sides)
    got = sorted(tuple(r) for r in readers.scan_parallel(spark, *sides).select("line_no", "src", "dst").collect())
    assert got == [(k + 1, src, (dst or "").replace("\n", " ")) for k, src, dst in rows]
    assert readers.scan_parallel(spark, *sides, drop_last=True).count() == 22


def test_text_vectors_and_stopwords(spark, tmp_path):
    (tmp_path / "v").write_text("2 3\na 1 2 3\nb 4 5 6\n", encoding="utf-8")
    rows = readers.scan_text_vectors(spark, str(tmp_path / "v"), 3).collect()
    assert {r["word"]: r["vec"] for r in rows} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    (tmp_path / "bad").write_text("2 3\na 1 2 3\nb 4 5\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a word and 3 values: b 4 5"):
        readers.scan_text_vectors(spark, str(tmp_path / "bad"), 3).collect()
    (tmp_path / "w").write_text(" a \nb\n", encoding="utf-8")
    assert {r[0] for r in readers.scan_stopwords(spark, str(tmp_path / "w")).collect()} == {"a", "b"}
    assert readers.scan_stopwords(spark).filter("word = 'the'").count() == 1
    with pytest.raises(ValueError):
        readers.check_vectors(spark.range(2), spark.range(3))


def test_settings_parse_booleans(tmp_path):
    (tmp_path / "k.conf").write_text(
        "[corpus]\nhscd_corpus_path = a\ncoid_corpus_path = b\n[tfidf]\ntfidf_threshold = 0.2\n"
        "[default]\ncorpus_sampling_ratio = 1\nuse_default_stopwords = False\nmin_count = 3\n[save]\nsave_path = out\n"
    )
    s = KeywordSettings.read(str(tmp_path / "k.conf"))
    assert (s.use_default_stopwords, s.tfidf_threshold, s.min_count, s.save_path) == (False, 0.2, 3, "out")


def test_keyword_file_job(spark, tmp_path):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("the apple\nthe pear\nthe\napple\n", encoding="utf-8")
    codes = tmp_path / "codes.txt"
    codes.write_text("pear apple\nthe\n", encoding="utf-8")
    settings = KeywordSettings(str(codes), str(corpus), min_count=1, save_path=str(tmp_path / "out"))
    rows = {(r["corpus"], r["line_no"]): r["keywords"] for r in jobs.keyword_file_job(spark, settings).collect()}
    assert rows == {(1, 1): "apple", (1, 2): "pear", (1, 3): "", (1, 4): "apple", (0, 1): "pear,apple", (0, 2): ""}
    saved = [{r[0] for r in spark.read.text(str(tmp_path / f"out/keywords/{c}")).collect()} for c in ("item", "code")]
    assert saved == [{"1|apple", "2|pear", "3|", "4|apple"}, {"1|pear,apple", "2|"}]
    meta = {r[0] for r in spark.read.text(str(tmp_path / "out/keywords/meta/text")).collect()}
    assert "empty_keywords_ratio : 33.33% (2/6)" in meta


def test_recommendation_job(spark, tmp_path):
    (tmp_path / "code").write_text("c1|a,b\n", encoding="utf-8")
    (tmp_path / "item").write_text("i1|a\ni2|z\ni3|b,a\n", encoding="utf-8")
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<float>")
    args = (str(tmp_path / "code"), str(tmp_path / "item"), materialize(known, "wv"), 2, str(tmp_path / "vec"))
    rows = jobs.recommendation_job(spark, *args, top_n=2).orderBy("rank").collect()
    assert [(r["code_key"], r["item_key"], round(r["cos"], 4)) for r in rows] == [("c1", "i3", 1.0), ("c1", "i1", 0.7071)]


def test_sampled_keyword_job_keeps_unseen_words(spark):
    rows = [(i, 1, f"common u{chr(97 + i % 26)}x") for i in range(40)]
    lines = spark.createDataFrame(rows, "doc_id bigint, line_no int, line string")
    settings = KeywordSettings(sampling_ratio=0.5, min_count=1)
    got = jobs.keyword_job(lines, settings)
    assert got.count() == 40
    assert got.filter(F.col("keywords").contains("common")).count() == 0
