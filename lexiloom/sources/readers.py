"""Readers of line-oriented files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..functions.text import HANGUL, clean_english_text, clean_script_text


def scan_lines(
    spark: SparkSession, paths: str | list[str], encoding: str | None = None, across: bool = False
) -> DataFrame:
    """``path, line_no, line`` of every file matching the paths, numbered from 1 per file.

    The files stay splittable: a line's number is its place inside its split plus the
    lines of the file's earlier splits. Only one row per split is gathered for that. With
    ``across`` numbers run on from file to file, in the order of their paths.
    """
    raw = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    placed = raw.withColumn("_mono", F.monotonically_increasing_id())
    splits = placed.groupBy("path", "_start").agg(F.count("*").alias("_size"), F.min("_mono").alias("_first"))
    order = Window.orderBy("path", "_start") if across else Window.partitionBy("path").orderBy("_start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = splits.select(
        "path", "_start", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    # One row per file split: Spark broadcasts them while they are few.
    numbered = placed.join(splits, ["path", "_start"])
    line = F.col("value") if encoding is None else F.decode(F.col("value").cast("binary"), encoding)
    return numbered.select(
        "path", (F.col("_mono") - F.col("_first") + F.col("_before") + 1).alias("line_no"), line.alias("line")
    )


def parse_key_value(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``key|w1,w2`` rows to ``key, words``, and the rows that have other than two fields."""
    parts = F.split(value, r"\|", -1)
    good = rows.filter(F.size(parts) == 2).select(
        *[c for c in rows.columns if c != value],
        parts[0].alias("key"),
        F.split(parts[1], ",", -1).alias("words"),
    )
    return good, rows.filter(F.size(parts) != 2)


def scan_key_value(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Keyed word lists; with ``strict`` a malformed row raises."""
    good, bad = parse_key_value(spark.read.text(path))
    if strict:
        wrong = bad.limit(3).collect()
        if wrong:
            raise ValueError(f"not key|words: {[r[0] for r in wrong]}")
    return good


def parse_labelled(value: Column, sep: str = "\t") -> tuple[Column, Column]:
    """Label and text around the first separator, which is taken literally."""
    parts = F.split(value, re.escape(sep).replace("\t", r"\t").replace("\\\\t", r"\t"), 2)
    return parts[0], F.get(parts, F.lit(1))


def scan_labelled(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    label, text = parse_labelled(F.col("line"), sep)
    return scan_lines(spark, path).select("line_no", label.alias("label"), text.alias("text"))


def scan_ratings(spark: SparkSession, path: str, letters: str = HANGUL) -> DataFrame:
    """Rating file with a header; rows without a letter of the script are dropped."""
    rows = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("quote", "")
        .schema("id string, document string, label int")
        .csv(path)
    )
    return rows.select("id", clean_script_text(F.col("document"), letters).alias("text"), "label").filter(
        F.length("text") > 0
    )


def scan_class_files(spark: SparkSession, files: dict[str, int], encoding: str = "ISO-8859-1") -> DataFrame:
    """One file per class, each with its label; sentences are cleaned."""
    out = None
    for path, label in files.items():
        part = scan_lines(spark, path, encoding).select(
            "line_no", clean_english_text(F.col("line")).alias("text"), F.lit(label).alias("label")
        )
        out = part if out is None else out.unionByName(part)
    return out


def zip_lines(source: DataFrame, target: DataFrame, drop_last: bool = False) -> DataFrame:
    """Align two numbered files by line; ``drop_last`` leaves the last line out."""
    both = source.select("line_no", F.col("line").alias("src")).join(
        target.select("line_no", F.col("line").alias("dst")), "line_no"
    )
    if not drop_last:
        return both
    last = source.agg(F.max("line_no").alias("_last"))
    return both.crossJoin(F.broadcast(last)).filter("line_no < _last").drop("_last")  # one row


def scan_parallel(spark: SparkSession, source: str, target: str, drop_last: bool = False) -> DataFrame:
    """``line_no, src, dst`` of two line-aligned corpora, each a file or a folder of files in order."""
    return zip_lines(scan_lines(spark, source, across=True), scan_lines(spark, target, across=True), drop_last)


def scan_text_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``word v1 v2 ...`` text vectors.

    A header (two whole numbers) and empty lines are left out. Any other row of another
    size is an error when it is read.
    """
    parts = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").rlike("^[0-9]+ [0-9]+ *$"))
    wrong = F.raise_error(F.concat(F.lit(f"not a word and {dim} values: "), F.substring("value", 1, 200)))
    sized = F.when(F.size(parts) == dim + 1, parts).otherwise(wrong)
    return rows.select(sized.alias("parts")).select(
        F.col("parts")[0].alias("word"), F.transform(F.slice("parts", 2, dim), lambda x: x.cast("float")).alias("vec")
    )


def check_vectors(ids: DataFrame, vectors: DataFrame) -> None:
    """Raise unless there are as many ids as vectors."""
    n_ids, n_vectors = ids.count(), vectors.count()
    if n_ids != n_vectors:
        raise ValueError(f"{n_ids} ids but {n_vectors} vectors")


def scan_stopwords(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Trimmed stop words of a file, or the default English list."""
    if path:
        return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()
    return spark.createDataFrame([(w,) for w in ENGLISH], "word string")
