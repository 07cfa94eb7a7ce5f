"""Exact and near dedup, decontamination: brute force, forced bounds, odd rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import components as stars
from lexiloom.llm import near as near_module
from lexiloom.llm.components import components
from lexiloom.llm.exact import exact_duplicates
from lexiloom.llm.near import near_duplicates
from lexiloom.llm.winnow import contamination
from lexiloom.llm.words import SLICE_BYTES
from lexiloom.runtime import materialize

WORDS = [f"w{i}" for i in range(400)] + ["Élan", "naïve", "ÀÉ", "ß"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def small_corpus():
    rng = random.Random(7)
    rows, passage = [], prose(rng, 60)
    for g in range(12):
        base = prose(rng, rng.choice([3, 4, 5, 8, 30, 90, 200, 400]))
        rows.append(base)
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 25)) for _ in range(rng.randrange(1, 9))]
        rows += [base.upper(), base.replace(" ", " \t\n"), f"{base}  "]
    rows += [f"{passage} {prose(rng, 25)}" for _ in range(40)]  # over half of the text is shared
    hub = prose(rng, 150)
    rows += [edited(rng, hub, 3) for _ in range(60)]
    rows += [None, "", " \n\t", None, "x", "X ", "aa bb", "AA\vbb", prose(rng, 5000), "é" * 9000, "é" * 8999 + " é"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def corpus():
    return small_corpus()


def frame(spark, rows):
    """Documents with null and clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("rid"), F.lit("x").alias("norm"),
        F.lit(0).alias("hits"), F.lit(0).alias("name"), F.lit(0).alias("digest"),
    )


@pytest.mark.parametrize("block,bits", [(4096, 128), (16, 128), (7, 3)])
def test_exact(spark, corpus, block, bits):
    want = brute.exact(corpus)
    got = exact_duplicates(frame(spark, corpus), block, bits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert len(got) == len(corpus)


def test_exact_repeated_rows_and_nothing(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (None, "ab"), (2, None), (3, "")]
    got = exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == 6
    assert sum(r["kept"] for r in got) == 3  # "ab", "other" and the empty text
    assert {r["group_size"] for r in got if r["doc_id"] in (2, 3)} == {2}
    assert exact_duplicates(frame(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("percent,keep,tile,hub,wide", [(80, 64, 256, 128, 1024), (85, 16, 8, 3, 1024), (85, 16, 8, 3, 48)])
def test_near(spark, corpus, percent, keep, tile, hub, wide, monkeypatch):
    monkeypatch.setattr(near_module, "HUB_ROWS", hub)
    sigmas = near_module.SIGMAS if keep == 64 else 3.9
    monkeypatch.setattr(near_module, "SIGMAS", sigmas)
    monkeypatch.setattr("lexiloom.llm.common.BROADCAST_IDS", 2_000_000 if keep == 64 else -1)
    want = brute.near(corpus, percent)
    got = near_duplicates(frame(spark, corpus), percent, keep=keep, tile=tile, wide=wide).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len(got) == len(corpus)


def test_near_repeated_rows_and_nothing(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "p q r s t u"), (4, "A B c d e  f"), (9, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(4, 2, 4), (5, 2, 4), (5, 2, 4), (5, 2, 5), (9, 0, 9)]
    assert near_duplicates(frame(spark, rows).filter("false")).count() == 0


def near_copies(rng, n):
    """Copies of one text that is not among them; no two are linked at 85, but all are at 60 and more."""
    base, out = [f"w{i}" for i in range(200)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(200), 4):
            words[at] = f"x{i}-{at}"
        out.append(" ".join(words))
    return out


def test_rows_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    written = {}

    def counted(df, label):
        out = materialize(df, label)
        if label in ("pairs", "found", "links", "proposed"):
            written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near_module, "materialize", counted)
    sizes = []
    for n in (400, 800):
        rows = list(enumerate(near_copies(random.Random(2), n)))
        rows.append((n, rows[7][1] + " one more end"))
        written.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 85, tile=128).collect()}
        assert got == brute.near(rows, 85)
        assert got[n][1] == 7
        sizes.append(dict(written))
    assert sum(sizes[1].values()) < 2.5 * sum(sizes[0].values())
    assert sizes[1]["found"] < 800


def test_a_large_group_is_not_sent_once_for_each_list(spark, monkeypatch):
    opened = []

    def counted(df, label):
        out = materialize(df, label)
        if label == "open":
            opened.append(out.count())
        return out

    monkeypatch.setattr(near_module, "materialize", counted)
    rows = list(enumerate(near_copies(random.Random(4), 200)))
    rows.append((200, rows[7][1] + " one more end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 85, tile=64).collect()}
    assert got == brute.near(rows, 85)
    assert got[200][1] == 7
    assert sum(opened) < 5 * len(rows)  # each row has about twenty lists


def test_no_more_is_asked_of_a_whole_set_than_its_share():
    sizes = near_module.np.arange(1, 1100)
    assert (near_module.least_shared(sizes, sizes, 85, 1024, near_module.np) <= near_module.np.ceil(0.85 * sizes)).all()


def test_components_of_hubs(spark):
    star = spark.range(1, 3000).selectExpr("id as u", "0L as v").union(spark.range(3001, 4000).selectExpr("id as u", "3000L as v"))
    got = {r["node"]: r["root"] for r in components(star.union(spark.createDataFrame([(3500, 17)], "u long, v long"))).collect()}
    assert got == {i: 0 for i in range(4000)}


def test_components_of_a_path(spark):
    n = 300
    edges = spark.range(n).filter("id < 299").selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(500, 400)], "u long, v long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 400: 400, 500: 400}


def test_components_plans_stay_small(spark, monkeypatch):
    """A plan holds one star step over one table; two steps over a union of three named 180 tables."""
    sources = []

    def counted(df, label):
        sources.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return materialize(df, label)

    monkeypatch.setattr(stars, "materialize", counted)
    edges = [spark.createDataFrame([(i + 1, i), (i + 10, i)], "u long, v long").repartition(2) for i in (0, 1, 100)]
    got = {r["node"]: r["root"] for r in components(edges[0].union(edges[1]).union(edges[2])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 0, 11: 0, 100: 100, 101: 100, 110: 100}
    assert max(sources) <= 10


def test_contamination(spark, corpus):
    rng = random.Random(3)
    texts = [t for _, t in corpus if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(texts).split()[5 : 5 + rng.randrange(13, 40)])) for i in range(25)]
    items += [(100, "w1"), (101, "w2 W3"), (102, None), (103, "..."), (104, prose(rng, 30)), (104, "w4 w5"), (105, "aa-bb")]
    rows = [(i, (t or "").replace(" ", ", ", 3) if i % 2 else t) for i, t in corpus]
    words = prose(rng, SLICE_BYTES // 2).split()  # longer than a slice, hit at both ends
    rows.append((9000, " ".join([*items[0][1].split(), *words, *items[1][1].split()])))
    want = brute.contaminated(rows, items)
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(0))
    for bits in (24, 6):
        got = contamination(frame(spark, rows), df, bits=bits).collect()
        found = {r["doc_id"]: tuple(r)[1:] for r in got}
        assert found == want
        assert len(got) == len(rows)
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())


def test_contamination_by_nothing(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(frame(spark, corpus), none).collect()
    assert len(got) == len(corpus) and not any(r["n_hit"] or r["contaminated"] for r in got)
    assert contamination(frame(spark, corpus).filter("false"), none).count() == 0
    twice = [(1, "a b c"), (1, "a b c"), (1, "d")]
    items = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    got = sorted(tuple(r)[:3] for r in contamination(frame(spark, twice), items).collect())
    assert got == [(1, 1, 0), (1, 3, 2), (1, 3, 2)]


def test_rows_without_id_among_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    text, other = " ".join(words), " ".join([*words[:100], "changed", *words[101:]])
    rows = [(None, text), (5, text), (9, other), (None, "alone in the world with no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(df, 85).collect() if r["component_id"])
    assert got == [(-1, 5, False), (5, 5, True), (9, 5, False)]
    lone = [r["kept"] for r in near_duplicates(df, 85).collect() if r["component_id"] is None]
    assert lone == [True]
