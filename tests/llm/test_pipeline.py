"""Every stage of the pipeline on its own input, against brute force."""

import math
import random

import brute
import pytest

import corpus_pipeline as pipeline
from lexiloom.llm.common import table
from lexiloom.llm.mixing import mixed
from lexiloom.llm.quality import quality_verdicts, thresholds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (input rows, output DataFrame) of each stage, as run() chains them."""
    docs, found = table(spark, SF, "documents"), {}
    for name, stage in pipeline.STAGES:
        out = pipeline.materialize(stage(spark, docs, SF), "stage")
        found[name] = (docs, out)
        docs = out
    return found


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(spark, stages):
    names = table(spark, SF, "documents").columns
    assert all(out.columns == names for _, out in list(stages.values())[:-1])


def test_quality(spark, stages):
    docs, out = stages["quality classifier"]
    want = {r["doc_id"] for r in quality_verdicts(docs, table(spark, SF, "labels")).collect() if r["accepted"]}
    assert {r["doc_id"] for r in out.collect()} == want
    good = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    assert len(good & want) >= 0.95 * len(good)


def test_limits_by_brute_force(spark):
    """Every group's quantiles, widened and drawn to the larger group's by its number of documents."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "en", "fr", None]), rng.uniform(1, 4), 4 ** rng.randrange(1, 6)) for _ in range(400)]
    rows += [("fr", 0.0, 0), ("xx", 2.0, 64)]
    frame = spark.createDataFrame([(lang, bits * n, n) for lang, bits, n in rows], "lang string, _bits double, _bytes long")
    upper, lower, slack, steady = 0.9, 0.1, 0.05, 20

    def own(values):
        steps, n = sorted(math.floor(v * 1000) for v in values), len(values)
        high = min(s for i, s in enumerate(steps, 1) if sum(x <= s for x in steps) >= upper * n) + 1
        low = min(s for i, s in enumerate(steps, 1) if sum(x <= s for x in steps) >= lower * n)
        return low / 1000 - slack * (1 + steady / n), high / 1000 + slack * (1 + steady / n)

    def mixed_limits(values, larger):
        w = len(values) / (len(values) + steady)
        return tuple(w * a + (1 - w) * b for a, b in zip(own(values), larger))

    real = [(lang, bits * n / max(n, 1), math.floor(math.log2(max(n, 1)) / 2)) for lang, bits, n in rows if n]
    want = {(None, None): own([v for _, v, _ in real])}
    for lang in {x for x, _, _ in real if x}:
        want[lang, None] = mixed_limits([v for x, v, _ in real if x == lang], want[None, None])
        for length in {k for x, _, k in real if x == lang}:
            want[lang, length] = mixed_limits([v for x, v, k in real if x == lang and k == length], want[lang, None])
    got = {(r["lang"], r["length"]): (r["low"], r["high"]) for r in thresholds(frame, upper, lower, slack, steady).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 0.0011 for k in want for a, b in zip(got[k], want[k]))


def test_near(stages):
    docs, out = stages["near duplicates"]
    rows = rows_of(docs)
    want = {i for i, (_, root) in brute.near(rows, pipeline.SIMILARITY).items() if i == root}
    assert {i for i, _ in rows_of(out)} == want and len(want) < len(rows)


def test_decontamination(spark, stages):
    docs, out = stages["benchmark decontamination"]
    rows, items = rows_of(docs), [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = {i for i, found in brute.contaminated(rows, items).items() if not found[4]}
    assert {i for i, _ in rows_of(out)} == want and len(want) < len(rows)


def test_mixing(stages):
    docs, out = stages["mixing to target weights"]
    want = {r["doc_id"] for r in mixed(docs).collect() if r["_kept"]}
    assert {i for i, _ in rows_of(out)} == want


def test_sharding(spark, stages):
    docs, out = stages["sharding"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in rows_of(docs))
    assert {r["doc_id"] for r in pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in rows}


@pytest.mark.parametrize("position", range(5))
def test_odd_tables(spark, position):
    """Nulls in any column, repeated rows, extra columns, an empty table."""
    name, stage = pipeline.STAGES[position]
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (None, "x", None, None, None), (2, None, None, "s", None), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as rid", "'x' as bits", "null as size", "0 as shard0")
    out = stage(spark, docs, SF)
    assert out.count() <= len(rows)
    if position < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.filter("false"), SF).count() == 0


def test_columns_named_like_helpers(spark):
    """Extra columns keep their values, whatever their names."""
    names = ["_bits", "_accepted", "_tokens", "_kept", "rid", "_length"]
    docs = table(spark, SF, "documents").selectExpr("*", *[f"doc_id * 10 + {i} AS {n}" for i, n in enumerate(names)])
    for stage in (pipeline.quality_stage, pipeline.mixing_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == r["doc_id"] * 10 + i for r in rows for i, n in enumerate(names))
