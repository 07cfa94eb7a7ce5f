"""Cleaning, tokenising and array rules on hand-written rows."""

from pyspark.sql import functions as F

from lexiloom.functions import arrays, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


def ids(spark, values, column):
    df = spark.createDataFrame([(values,)], "ids array<int>")
    return df.select(column.alias("out")).first()["out"]


def test_keyword_cleaning(spark):
    got = one(spark, text.clean_keyword_text(F.col("s")), s="  1. Foo,bar/BAZ-qux|x ")
    assert got == " foobarbaz-quxx"
    assert one(spark, text.clean_keyword_text(F.col("s")), s="‘A’ “Bㅣ” 12　") == "a bㅣ "


def test_english_cleaning(spark):
    clean = text.clean_english_text(F.col("s"))
    assert one(spark, clean, s="It's (a) test, isn't it?") == r"It 's \( a \) test , is n't it \?"
    plain = text.clean_english_text(F.col("s"), keep_escape=False)
    assert one(spark, plain, s="(a)?") == "( a ) ?"


def test_script_cleaning(spark):
    assert one(spark, text.clean_script_text(F.col("s")), s="가나 abc 12") == "가나  "
    assert one(spark, text.clean_script_text(F.col("s")), s="abc") == ""


def test_tokenising(spark):
    assert one(spark, text.tokenize_delims(F.col("s"), keep_empty=True), s="a  b") == ["a", "", "b"]
    assert one(spark, text.tokenize_delims(F.col("s")), s="a  b.c,\td") == ["a", "b", "c", "d"]
    assert one(spark, text.tokenize_space(F.col("s")), s="a  b") == ["a", "", "b"]
    assert one(spark, text.tokenize_words(F.col("s")), s="A bc, d-éf") == ["bc", "éf"]
    assert one(spark, text.distinct_words(F.col("s")), s="b,A,b,a") == ["a", "b"]
    assert one(spark, text.prefix_pieces(F.split("s", " ")), s="x y z") == "x ##y ##z"
    assert one(spark, text.keep_words(F.col("s"), text.tokenize_delims, ["a"]), s="a b a c") == "b,c"


def test_normalize(spark):
    assert one(spark, text.normalize_line(F.col("s")), s=" AB\nc ") == " abc "
    assert one(spark, text.normalize_line(F.col("s"), trim=True), s=" AB\nc ") == "abc"


def test_term_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(arrays.term_runs(F.col("t"))).collect()]
    assert got == [[("a", 1, 1), ("b", 2, 0)], []]


def test_sequences(spark):
    c = F.col("ids")
    assert ids(spark, [4, 5], arrays.frame_sequence(c, reverse=True)) == [2, 5, 4, 3]
    assert ids(spark, [4, 5], arrays.pad_fixed(c, 3)) == [4, 5, 0]
    assert ids(spark, [4, 5, 6, 7], arrays.pad_fixed(c, 3)) == [4, 5, 6]
    assert ids(spark, [2, 9, 9, 3, 9, 3], arrays.segment_ids(c)) == [1, 1, 1, 1, 2, 2]
    assert ids(spark, [7, 0, 0], arrays.attention_mask(c)) == [1, 0, 0]
    assert ids(spark, [2, 8, 3], arrays.shift_inputs(c)) == [2, 8]
    assert ids(spark, [2, 8, 3], arrays.shift_targets(c)) == [8, 3]
    assert ids(spark, [1, 5, 5], arrays.argmax_class(c)) == 1


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (-0.1,)], "x double")
    assert [r[0] for r in df.select(arrays.sigmoid_round(F.col("x"))).collect()] == [0, 1, 0]
    assert one(spark, arrays.format_ratio(F.col("a"), F.col("b")), a=1, b=3) == "33.33% (1/3)"
    assert one(spark, arrays.split_minutes(F.col("s")), s=125.7) == 2
    assert one(spark, arrays.split_seconds(F.col("s")), s=125.7) == 5
