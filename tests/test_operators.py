"""Operators on small fixtures, with brute-force counterparts and uneven keys."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays, hashing
from lexiloom.functions.arrays import MASK
from lexiloom.catalog import QUERIES, evaluation, learning
from lexiloom.operators import encode, evaluate, instances, joins, ml, ranking, splits, subwords, terms, vectors, vocab
from lexiloom.operators.keywords import drop_stopwords, extract_keywords
from lexiloom.operators.terms import KEYS
from lexiloom.runtime import materialize


def tokens_table(spark, lines):
    rows = [(0, i + 1, line.split()) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id bigint, line_no int, tokens array<string>")


def test_term_stats_by_hand(spark):
    lines = ["a a b", "a c", "", "b"]
    stats = {r["word"]: r for r in terms.term_stats(tokens_table(spark, lines)).collect()}
    assert set(stats) == {"a", "b", "c"}
    assert stats["a"]["c_d"] == 3 and stats["a"]["i_d"] == 2 and stats["a"]["total"] == 3
    assert stats["a"]["min_tf"] == 0.5 and math.isclose(stats["c"]["idf"], math.log(3))


def test_term_stats_scans_once(spark):
    df = terms.term_stats(tokens_table(spark, ["a b", "b"]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_stop_rule_is_any_line(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = [line.split() for line in lines]
    idf = {w: math.log(len(docs) / sum(w in d for d in docs)) for d in docs for w in d}
    low = {w for d in docs for w in d if d.count(w) / len(d) * idf[w] < 0.25}
    rare = {w for w in idf if sum(d.count(w) for d in docs) < 30}
    found = terms.derive_stopwords(terms.term_stats(tokens_table(spark, lines)), 0.25, 30)
    assert {r[0] for r in found.collect()} == low | rare


def test_keywords_keep_order_and_empty_lines(spark):
    table = tokens_table(spark, ["z k k", "", "stop"])
    keep = materialize(spark.createDataFrame([("z", 1), ("k", 2)], "word string, total bigint"), "keep")
    rows = {r["line_no"]: (r["keywords"], r["cnt"]) for r in extract_keywords(table, keep=keep).collect()}
    assert rows == {1: ("z,k,k", 3), 2: ("", 0), 3: ("", 0)}
    stops = materialize(spark.createDataFrame([("stop",)], "word string"), "stops")
    again = {r["line_no"]: (r["keywords"], r["cnt"]) for r in extract_keywords(table, stops=stops).collect()}
    assert again == rows


@pytest.mark.parametrize("limit", [1_000, 3])
def test_lookup_with_a_hot_key(spark, limit, monkeypatch):
    """A third of all rows under one key; both ways of joining give the same."""
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    keys = ["hot"] * 400 + [f"w{i % 40}" for i in range(800)] + [None]
    left = spark.createDataFrame(list(enumerate(keys)), "id bigint, word string")
    right = [("hot", 1, 400), *[(f"w{i}", i + 2, 20) for i in range(30)]]
    table = materialize(spark.createDataFrame(right, "word string, v int, cnt bigint"), "t")
    want = {r[0]: r[1] for r in right}
    got = joins.lookup_join(left, table, "word", ["v"], hot_by="cnt", limit=limit).collect()
    assert len(got) == len(keys)
    assert all(r["v"] == want.get(r["word"]) for r in got)


def test_lookup_shuffles_unanswered_rows_only(spark, monkeypatch):
    """Rows of the frequent words are answered in place; also where a second lookup follows."""
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    keys = ["hot"] * 900 + ["warm"] * 50 + [f"w{i}" for i in range(45)] + [None] * 5
    rows = [(i, w, "hot" if i % 3 else f"w{i % 40}") for i, w in enumerate(keys)]
    left = materialize(spark.createDataFrame(rows, "id bigint, word string, other string"), "left")
    right = [("hot", 1, 900), ("warm", 2, 50), *[(f"w{i}", i + 3, 1) for i in range(30)]]
    table = materialize(spark.createDataFrame(right, "word string, v int, cnt bigint"), "t")
    want = {r[0]: r[1] for r in right}
    found = joins.lookup_join(left, table, "word", ["v"], hot_by="cnt", limit=3)
    again = found.withColumnsRenamed({"v": "first", "word": "own", "other": "word"})
    both = joins.lookup_join(again, table, "word", ["v"], hot_by="cnt", limit=3)
    assert {r["id"]: (r["first"], r["v"]) for r in both.collect()} == {i: (want.get(a), want.get(b)) for i, a, b in rows}
    assert both.count() == len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # the answered rows are no side of the shuffled join


def test_drop_stopwords_with_judged_words(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (None, 1))
    tokens = spark.createDataFrame([(1, "stay"), (2, "stop"), (3, "stay"), (4, "new"), (5, "rare")], "id bigint, word string")
    judged = materialize(spark.createDataFrame([("stay", False, 9), ("stop", True, 5), ("rare", True, 1)], "word string, stop boolean, total bigint"), "j")
    stops = materialize(judged.filter("stop").select("word", "total"), "s")
    for table in (judged, stops):
        assert sorted(r["id"] for r in drop_stopwords(tokens, table, "total").collect()) == [1, 3, 4]


def uneven(spark, n=1000):
    """One document with a third of all lines."""
    rows = [(7, i) for i in range(n // 3)] + [(i + 10, 1) for i in range(n - n // 3)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, line_no int").repartition(7), sorted(rows)


def test_global_rank(spark):
    df, rows = uneven(spark)
    got = ranking.global_rank(df, KEYS, "r", "n").collect()
    assert {(r["doc_id"], r["line_no"]): r["r"] for r in got} == {k: i for i, k in enumerate(rows)}
    assert {r["n"] for r in got} == {len(rows)}


def test_hash_rank_is_a_permutation_and_stable(spark):
    df, rows = uneven(spark)
    first = {(r[0], r[1]): r["rank"] for r in ranking.hash_rank(df, KEYS, 1).collect()}
    second = {(r[0], r[1]): r["rank"] for r in ranking.hash_rank(df.coalesce(1), KEYS, 1, digits=1).collect()}
    assert sorted(first.values()) == list(range(len(rows))) and first == second


def test_chunks(spark):
    df = spark.range(23).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_no"))
    sizes = ranking.near_equal_chunks(df, KEYS, 5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [5, 5, 5, 4, 4]


def test_splits(spark):
    df, rows = uneven(spark, 997)
    ranked = {(r[0], r[1]): r["rank"] for r in ranking.hash_rank(df, KEYS, 12).collect()}
    folds = splits.kfold_assign(df, KEYS, 10, 12).collect()
    sizes = [sum(r["fold"] == f for r in folds) for f in range(10)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    border = np.cumsum([0, *sizes])
    assert all(border[r["fold"]] <= ranked[(r["doc_id"], r["line_no"])] < border[r["fold"] + 1] for r in folds)
    assert splits.sample_exact(df, KEYS, 0.31, 4).count() == math.ceil(len(rows) * 0.31)
    assert splits.train_test_split(df, KEYS, 1.0).filter("NOT is_train").count() == 0


def test_vocabulary(spark):
    table = tokens_table(spark, ["b a b c a"])
    counts = vocab.token_counts(table)
    words = materialize(vocab.most_common_vocab(counts, 2), "v")
    assert {r["token"]: r["id"] for r in words.collect()} == {"b": 4, "a": 5}
    seen = {r["token"]: r["id"] for r in vocab.first_seen_vocab(counts).collect()}
    assert seen == {"b": 4, "a": 5, "c": 6}
    coded = encode.encode_tokens(tokens_table(spark, ["b zzz", ""]), words)
    assert {r["line_no"]: r["ids"] for r in coded.collect()} == {1: [4, 1], 2: []}
    assert {r["line_no"]: r["text"] for r in encode.decode_ids(coded, words).collect()} == {1: "b", 2: ""}


def test_next_sentence_pairs(spark):
    rows = [(d, i, 6, f"{d}-{i}") for d in range(40) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, line_no int, n_lines int, line string")
    got = instances.next_sentence_pairs(df, 3).collect()
    order = {text: i for i, (_, _, _, text) in enumerate(rows)}
    assert len(got) == len(rows)
    for r in got:
        step = order[r["line_b"]] - order[r["line"]]
        assert step == 1 if r["nsp"] else step not in (0, 1)
    share = sum(r["nsp"] for r in got) / len(got)
    assert 0.3 < share < 0.55


@pytest.mark.parametrize("m,masked,random_", [(10, 3, 0), (20, 5, 1), (1, 1, 0), (0, 0, 0)])
def test_mask_counts(spark, m, masked, random_):
    ids = [2, *range(1000, 1000 + m), 3]
    df = spark.createDataFrame([(i, 1, ids) for i in range(20)], "doc_id bigint, line_no int, ids array<int>")
    for r in instances.mask_tokens(df, KEYS, 900, 5).collect():
        assert r["labels"] == ids and sum(r["marks"]) == math.ceil(0.3 * m)
        assert sum(x == MASK for x in r["inputs"]) == masked
        changed = [x for x, y in zip(r["inputs"], ids) if x != y and x != MASK]
        assert len(changed) == random_ and all(5 <= x < 900 for x in changed)
        assert r["marks"][0] == r["marks"][-1] == 0


@pytest.mark.parametrize("na,nb,ka,kb", [(3, 4, 3, 4), (100, 300, 100, 153), (200, 300, 126, 127), (300, 200, 127, 126)])
def test_join_pair_cuts_the_longer_side(spark, na, nb, ka, kb):
    df = spark.createDataFrame([([5] * na, [6] * nb)], "a array<int>, b array<int>")
    got = df.select(instances.join_pair(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert got == [2] + [5] * ka + [3] + [6] * kb + [3]


def vector_table(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id bigint, vec array<float>")


@pytest.mark.parametrize("query_rows", [1000, 0])
def test_recommend_with_many_equal_vectors(spark, query_rows, monkeypatch):
    """A third of the targets are copies of one vector; equal cosines rank by id."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(9, 5)).astype(np.float32)
    b = rng.normal(size=(90, 5)).astype(np.float32)
    b[::3] = a[0]
    b[1] = 0
    unit = lambda m: m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-30)
    sims = np.round(unit(a) @ unit(b).T, 9)
    want = {(i, k + 1): int(j) + 100 for i in range(9) for k, j in enumerate(np.lexsort((np.arange(90), -sims[i]))[:20])}
    targets = vector_table(spark, b, 100).repartition(5)
    got = vectors.recommend_topn(vector_table(spark, a), targets, "vec_id", "vec", 20, query_rows=query_rows).collect()
    assert {(r["q_id"], r["rank"]): r["t_id"] for r in got} == want


@pytest.mark.parametrize("query_rows", [1000, 0])
def test_ranked_lists(spark, query_rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(10, 3))
    best = vectors.recommend_topn(vector_table(spark, b), vector_table(spark, a), "vec_id", "vec", 5, query_rows=query_rows)
    got = {r["q_id"]: r for r in vectors.ranked_lists(best).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(b) @ unit(a).T
    assert {j: list(r["ranked"]) for j, r in got.items()} == {j: np.argsort(-sims[j])[:5].tolist() for j in range(10)}
    for j, r in got.items():
        assert np.allclose(r["cos"], np.sort(sims[j])[::-1][:5], atol=1e-6)


def test_topn_limits_and_unknown_ids(spark):
    a, b = vector_table(spark, np.eye(3)), vector_table(spark, np.eye(3), 10)
    assert vectors.recommend_topn(a, b, "vec_id", "vec", 20).count() == 9
    wanted = spark.createDataFrame([(0,), (99,)], "vec_id bigint")
    with pytest.raises(KeyError):
        vectors.recommend_topn(a, b, "vec_id", "vec", 20, source_ids=wanted)
    some = spark.createDataFrame([(10,), (12,)], "vec_id bigint")
    got = vectors.recommend_topn(a, b, "vec_id", "vec", 20, target_ids=some).collect()
    assert {r["t_id"] for r in got} == {10, 12}


def test_string_ids(spark):
    rows = [("x", [1.0, 0.0]), ("y", [1.0, 0.0]), ("z", [0.0, 1.0])]
    table = spark.createDataFrame(rows, "key string, vec array<double>")
    for query_rows in (10, 0):
        got = vectors.recommend_topn(table, table, "key", "vec", 1, query_rows=query_rows).collect()
        assert {r["q_id"]: r["t_id"] for r in got} == {"x": "x", "y": "x", "z": "z"}


def test_centroid_counts_repeats(spark):
    rows = [("k", ["a", "a", "b"]), ("none", ["q"]), ("empty", [])]
    words = spark.createDataFrame(rows, "key string, words array<string>")
    known = materialize(spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 6.0])], "word string, vec array<float>"), "w")
    for inline in (None, -1):
        rows = vectors.keyed_centroids(words, known, "key", 2, inline).collect()
        assert {r["key"]: r["found"] for r in rows} == {"k": 3, "none": 0, "empty": 0}
        got = {r["key"]: r["centroid"] for r in rows}
        assert got == {"k": [2.0, 2.0], "none": [0.0, 0.0], "empty": [0.0, 0.0]}


def test_consistency_counts(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0])]
    r = vectors.vector_consistency(spark.createDataFrame(rows, "id bigint, vec array<float>"), "id", "vec", 2).first()
    assert (r["total"], r["missing_vectors"], r["duplicate_ids"], r["wrong_dim"]) == (4, 1, 1, 1)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    assert round(evaluate.macro_f1(df, "label", "pred").first()[0], 6) == 0.666667
    probs = spark.createDataFrame([(0.5,), (0.25,)], "p double")
    assert round(evaluate.perplexity(probs, "p").first()["perplexity"], 6) == 2.828427
    runs = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3)], "run int, loss double")
    assert evaluate.best_run(runs, "run", "loss").first()["run"] == 2


def brute_bleu(cand, ref):
    logs = []
    for n in range(1, 5):
        c = [tuple(cand[i : i + n]) for i in range(len(cand) - n + 1)]
        r = [tuple(ref[i : i + n]) for i in range(len(ref) - n + 1)]
        hit = sum(min(c.count(g), r.count(g)) for g in set(c))
        if not hit:
            return 0.0
        logs.append(math.log(hit / len(c)))
    return math.exp(sum(logs) / 4) * math.exp(min(1 - len(ref) / len(cand), 0))


def test_bleu_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 15))], [rng.choice("abc") for _ in range(rng.randint(0, 15))]) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, c array<string>, r array<string>")
    got = {r["k"]: r["bleu"] for r in evaluate.bleu_sentence(df, "k", "c", "r").collect()}
    for k, c, r in rows:
        assert math.isclose(got[k], brute_bleu(c, r), abs_tol=1e-9)


def brute_merges(words, steps, min_freq):
    state = {tuple(c if i == 0 else "##" + c for i, c in enumerate(w)): n for w, n in words.items()}
    merges = []
    for _ in range(steps):
        pairs = {}
        for s, n in state.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + n
        pairs = {p: n for p, n in pairs.items() if n >= min_freq}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(subwords.merged(*best))
        new = {}
        for s, n in state.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    out.append(subwords.merged(*best))
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + n
        state = new
    return merges


def test_subwords_match_one_by_one_merging(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))): rng.randint(1, 60) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "word string, cnt bigint")
    size = 5 + 10 + 12
    got = subwords.train_subwords(df, size, min_freq=3)
    learned = [r["token"] for r in got.orderBy("id").collect() if r["step"] > 0]
    assert learned == brute_merges(words, len(learned), 3)


def test_subwords_learn_beyond_a_large_alphabet(spark):
    words = [("".join(chr(0x4E00 + i + j) for j in range(3)), 5) for i in range(0, 90, 3)] + [("abab", 9), ("abcab", 4)]
    df = spark.createDataFrame(words, "word string, cnt bigint")
    got = subwords.train_subwords(df, merges_beyond=12).orderBy("id").collect()
    learned = [r["token"] for r in got if r["step"] > 0]
    assert len(got) - len(learned) > 60 and learned == brute_merges(dict(words), 12, 3)


def brute_merge_list(words, steps, min_freq):
    """Pairs and counts of one-by-one merging, with counts kept up to date."""
    state = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in words}
    pairs = collections.Counter()
    for w, s in state.items():
        for p in zip(s, s[1:]):
            pairs[p] += words[w]
    found = []
    while len(found) < steps:
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < min_freq:
            break
        found.append((*best, pairs[best]))
        for w, s in state.items():
            if best in zip(s, s[1:]):
                made = subwords.merge_once(s, best)
                for p in zip(s, s[1:]):
                    pairs[p] -= words[w]
                for p in zip(made, made[1:]):
                    pairs[p] += words[w]
                state[w] = made
    return found


@pytest.mark.parametrize("most", [100_000, 300])
def test_merge_list_equals_one_by_one(spark, most):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    words = collections.Counter(w for r in rows[:60] for w in (r["text"] or "").lower().split() if w.isalpha())
    words["abab"] = words["cabab"] = words["aaaaa"] = 40
    df = spark.createDataFrame(list(words.items()), "word string, cnt bigint")
    got = list(subwords.learn_merges(subwords.word_symbols(df).repartition(4), set(), 10_000, 5, most))
    assert len(got) >= 500 and max(r[0] for r in got) < len(got) / 3
    assert [r[1:] for r in got] == brute_merge_list(words, 10_000, 5)


def test_registered_subwords_learn_their_vocabulary(spark):
    got = learning.train_subwords(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["step"] > 0 for r in got) >= 500


def test_greedy_pieces():
    table = {"ab": 5, "a": 6, "##c": 7, "##bc": 8}
    assert subwords.greedy_pieces("abc", table) == [5, 7]
    assert subwords.greedy_pieces("abx", table) == [1]
    long = "ab" + "bc" * 50_000
    assert subwords.greedy_pieces(long, table, longest=2) == [5] + [8] * 50_000


def test_results_do_not_depend_on_partitioning(spark):
    lines = [f"w{i % 7} w{i % 5} common" for i in range(50)]
    table = tokens_table(spark, lines)
    runs = []
    for n in (1, 8):
        stats = terms.term_stats(table.repartition(n))
        runs.append(sorted(map(tuple, stats.collect())))
    assert runs[0] == runs[1]


def test_release_removes_only_written_tables(spark):
    import os

    from lexiloom import runtime

    kept, runtime._written[:] = list(runtime._written), []
    table = materialize(spark.range(3).select("id"), "gone")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and runtime.release(spark) == 1 and not os.path.exists(folder)
    runtime._written[:] = kept


def test_coding_in_the_row_and_by_join(spark):
    rows = [(1, ["a", "b", "zz", "a"]), (2, []), (3, None), (4, ["zz"]), (5, [None, "b"]), (6, ["a"] * 500)]
    lines = materialize(spark.createDataFrame(rows, "k int, tokens array<string>"), "lines")
    words = materialize(spark.createDataFrame([("a", 4, 502), ("b", 5, 2)], "token string, id int, cnt bigint"), "vocab")
    chars = materialize(spark.createDataFrame([(4, [7, 0, 0]), (5, [8, 9, 0])], "id int, chars array<int>"), "chars")
    found = []
    for inline in (100_000, -1):
        ids = encode.encode_tokens(lines, words, ["k"], inline=inline)
        framed = encode.frame_all(ids, "ids")
        grids = encode.char_grids(framed, chars, ["k"], 3, inline=inline)
        text = encode.decode_ids(framed, words, ["k"], inline=inline)
        found.append([{r["k"]: r[1] for r in df.collect()} for df in (ids, grids, text)])
        if inline > 0:
            assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1]
    ids, grids, text = found[0]
    assert ids == {1: [4, 5, 1, 4], 2: [], 3: [], 4: [1], 5: [1, 5], 6: [4] * 500}
    assert grids[1] == [[2, 0, 0], [7, 0, 0], [8, 9, 0], [1, 0, 0], [7, 0, 0], [3, 0, 0]]
    assert text == {1: "a b a", 2: "", 3: "", 4: "", 5: "b", 6: " ".join("a" * 500)}


def test_lookup_of_a_word_in_most_rows(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 10 < 9, "zz").otherwise(F.col("id").cast("string")).alias("word"))
    table = materialize(spark.range(0, 1000, 5).select(F.col("id").cast("string").alias("word"), F.col("id").alias("v")).union(spark.createDataFrame([("zz", -1)], "word string, v bigint")), "t")
    got = {r["id"]: r["v"] for r in joins.lookup_join(left, table, "word", ["v"], limit=-1).collect()}
    assert got == {i: -1 if i % 10 < 9 else (i if i % 5 == 0 else None) for i in range(1000)}


@pytest.mark.parametrize("cells", [4 << 20, 40])
def test_context_sums(spark, cells, monkeypatch):
    monkeypatch.setattr(ml, "SLICE_CELLS", cells)
    rng = random.Random(3)
    rows = [[rng.choice("abcdef") for _ in range(rng.randrange(20))] for _ in range(60)] + [["alone"], []]
    near, sums = {}, {}
    for words in rows:
        for i, w in enumerate(words):
            own = [words[j] for j in range(max(0, i - 5), min(len(words), i + 6)) if j != i]
            near[w] = near.get(w, 0) + len(own)
            sums[w] = sums.get(w, np.zeros(7, int)) + sum((ml.sign_row(x, 7, 1) for x in own), np.zeros(7, int))
    df = spark.createDataFrame([(r,) for r in rows], "words array<string>").repartition(3)
    got = {r["word"]: (r["near"], r["sums"]) for r in ml.context_sums(df, 7).collect()}
    assert got == {w: (near[w], sums[w].tolist()) for w in near}


def test_one_plan_for_few_and_many_files(spark, tmp_path):
    """The exchanges of a query do not depend on the number of files."""
    from lexiloom.sources import tables

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = []
    for files in (1, 32):
        folder = tmp_path / str(files)
        docs.repartition(files).write.parquet(str(folder / "documents.parquet"))
        lines = tables.lines(spark, str(folder))
        plan = lines.groupBy("doc_id", "line_no").count()._jdf.queryExecution().executedPlan().toString()
        counts.append(plan.count("hashpartitioning(doc_id"))
    assert counts[0] == counts[1] == 1


def test_exact_ranks_in_blocks(spark, monkeypatch):
    """Ranks over several blocks, with ties, zero vectors and one source that asks for all."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    sides = {"q": rng.integers(-2, 3, (5, 4)).astype(float), "t": rng.integers(-2, 3, (40, 4)).astype(float)}
    sides["t"][3] = 0
    frames = {k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>") for k, m in sides.items()}
    asked = [(0, i) for i in range(40)] + [(q, t) for q in range(1, 5) for t in (3, 17, 39)]
    got = vectors.exact_ranks(spark.createDataFrame(asked, "q_id long, t_id long"), frames["q"], frames["t"], "id", "vec").collect()
    unit = {k: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for k, m in sides.items()}
    sims = np.round(unit["q"] @ unit["t"].T, 9)
    want = {(q, t): 1 + int(sum((sims[q] > sims[q, t]) | ((sims[q] == sims[q, t]) & (np.arange(40) < t)))) for q, t in asked}
    assert {(r["q_id"], r["t_id"]): r["rank"] for r in got} == want


@pytest.mark.parametrize("length", [3, 52, 70])
def test_numbered_md5(length):
    texts = [bytes(random.Random(k).choices(range(1, 256), k=max(0, length - k))) for k in range(5)]
    row, number = np.repeat(np.arange(5), 300), np.tile(np.arange(300), 5)
    head, tail = hashing.numbered_md5(texts, row, number)
    want = [hashlib.md5(texts[r] + str(i).encode()).hexdigest() for r, i in zip(row, number)]
    assert [f"{x:016x}{y:016x}" for x, y in zip(head.tolist(), tail.tolist())] == want


@pytest.mark.parametrize("length", [256, 12])
def test_instances_in_one_kernel(spark, length):
    """Instances equal those that the array rules make row by row, as arrays and as text, without being built as arrays in the plan."""
    rng = random.Random(2)
    rows = [(d, k, 4, [rng.randrange(1, 40) for _ in range(rng.choice([0, 1, 3, 9, 200]))]) for d in range(12) for k in range(1, 5)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, n_lines int, ids array<int>")
    pairs = instances.next_sentence_pairs(lines, 7, carry=["ids"])
    joined = pairs.select(*KEYS, "nsp", instances.join_pair(F.col("ids"), F.col("ids_b"), length).alias("ids"))
    masked = instances.mask_tokens(joined, KEYS, 900, 7)
    columns = (F.col("inputs"), arrays.segment_ids(F.col("ids")), arrays.attention_mask(F.col("ids")), F.col("labels"), F.col("marks"))
    want = masked.select(*KEYS, "nsp", *[arrays.pad_fixed(c, length).alias(n) for c, n in zip(columns, instances.INSTANCE)])
    made = instances.nsp_mlm_instances(lines, 900, 7, length)
    assert "transform" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.orderBy(*KEYS).collect() == want.orderBy(*KEYS).collect()
    text = instances.nsp_mlm_instances(lines, 900, 7, length, texts=True).orderBy(*KEYS).collect()
    assert text == want.select(*KEYS, "nsp", *[encode.render(F.col(c)).alias(c) for c in instances.INSTANCE]).orderBy(*KEYS).collect()


@pytest.mark.parametrize("sent", [True, False])
def test_exact_ranks_move_ids_only(spark, monkeypatch, sent):
    """Asked pairs travel without vectors, targets are sent or stream past in several pieces; equal to full lists."""
    for name, value in (("ASKED_ROWS", 30), ("TARGET_ROWS", 9), *([] if sent else [("QUERY_BYTES", 500)])):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    sides = {"q": rng.integers(-2, 3, (7, 5)).astype(float), "t": rng.integers(-2, 3, (50, 5)).astype(float)}
    sides["t"][7] = sides["q"][1] = 0
    frames = {k: spark.createDataFrame([(f"{k}{i:02}", v.tolist()) for i, v in enumerate(m)], "id string, vec array<float>") for k, m in sides.items()}
    asked = [(0, i) for i in range(50)] + [(q, t) for q in range(1, 6) for t in range(q, 50, 4 * q)]
    df = spark.createDataFrame([(f"q{q:02}", f"t{t:02}") for q, t in asked * 2], "q_id string, t_id string")
    made = vectors.exact_ranks(df, frames["q"], frames["t"], "id", "vec")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Cogroup" not in plan  # no copies of pairs for each block of targets
    got = made.collect()
    unit = {k: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for k, m in sides.items()}
    sims = np.round(unit["q"] @ unit["t"].T, 9)
    want = {(f"q{q:02}", f"t{t:02}"): 1 + int(sum((sims[q] > sims[q, t]) | ((sims[q] == sims[q, t]) & (np.arange(50) < t)))) for q, t in asked}
    assert {(r["q_id"], r["t_id"]): r["rank"] for r in got} == want and len(got) == len(want)
    assert all(abs(r["cos"] - sims[int(r["q_id"][1:]), int(r["t_id"][1:])]) < 1e-12 for r in got)
    with pytest.raises(KeyError):
        vectors.exact_ranks(df.union(spark.createDataFrame([("q00", "none")], df.schema)), frames["q"], frames["t"], "id", "vec")


def test_hash_rank_with_longer_prefixes(spark, monkeypatch):
    """More rows than a bucket may hold: longer prefixes, joined instead of broadcast, same places."""
    df = spark.range(700).withColumnRenamed("id", "k")
    plain = {r["k"]: (r["rank"], r["n"]) for r in ranking.hash_rank(df, ["k"], 5, total="n").collect()}
    monkeypatch.setattr(ranking, "LEAST_DIGITS", 1)
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 4)
    monkeypatch.setattr(ranking, "fits_broadcast", lambda table: False)
    assert ranking.bucket_digits(700) == 2
    assert {r["k"]: (r["rank"], r["n"]) for r in ranking.hash_rank(df, ["k"], 5, total="n").collect()} == plain
    folds = [r["fold"] for r in splits.kfold_assign(df, ["k"], 7, 5).collect()]
    assert sorted(collections.Counter(folds).values()) == [100] * 7


def test_running_best_over_ranges(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, rng.random()])) for g in ("a", None, "b") for i in range(200 if g else 1)]
    df = spark.createDataFrame(rows, "g string, run int, loss double").repartition(7)
    got = {(r["g"], r["run"]): (r["best_before"], r["improved"]) for r in evaluate.running_best(df, "run", "loss", "g").collect()}
    for g, i, loss in rows:
        before = [x for h, j, x in rows if h == g and j < i and x is not None]
        best = min(before, default=None)
        want = True if best is None else None if loss is None else loss < best
        assert got[g, i] == (best, want)


def test_grid_texts_are_the_grids(spark):
    coded = spark.createDataFrame([(1, 1, [2, 5, 9, 3]), (1, 2, []), (2, 1, [7])], "doc_id int, line_no int, ids array<int>")
    table = spark.createDataFrame([(5, list(range(10, 20))), (7, [4] * 10)], "id int, chars array<int>")
    table = table.withColumn("cnt", F.lit(1))
    found = []
    for inline in (100, 0):
        rows = encode.char_grid_texts(coded, table, inline=inline).collect()
        found.append({(r["doc_id"], r["line_no"]): (r["n_rows"], r["text"]) for r in rows})
    assert found[0] == found[1]
    assert found[0][2, 1] == (1, "4 4 4 4 4 4 4 4 4 4") and found[0][1, 2] == (0, "")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_subwords_are_coded_inside_their_rows(spark):
    table = {"a": 5, "ab": 6, "##b": 7, "##ab": 8, "b": 9}
    lines = [["ab", "abab", "a"], [], ["x", "", "b"], ["abb"] * 300, None]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc_id bigint, line_no int, tokens array<string>")
    coded = subwords.encode_subwords(rows, spark.createDataFrame(list(table.items()), "token string, id int"), KEYS)
    assert "Exchange" not in plan_of(coded)
    for r in coded.collect():
        pieces = [x for w in lines[r["line_no"]] or [] for x in subwords.greedy_pieces(w, table)]
        assert r["ids"] == [2, *pieces[:254], 3]
    assert coded.count() == len(lines)


@pytest.mark.parametrize("sent", [100_000, 3])
def test_smooth_weights_of_whole_lines(spark, sent):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("aabbcdefghij") for _ in range(rng.randint(0, 12))) for _ in range(50)] + ["z z y"]
    table = tokens_table(spark, lines)
    stats = materialize(terms.smooth_stats(table), "smooth")
    found = terms.tfidf_smooth_l2(table, stats, sent=sent)
    assert "Window" not in plan_of(found)
    docs = [collections.Counter(line.split()) for line in lines]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for d in docs for w in d}
    want = {}
    for i, d in enumerate(docs):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in d.items()))
        want |= {(i + 1, w): n * idf[w] / norm for w, n in d.items()}
    rows = found.collect()
    assert len(rows) == len(want)
    assert {(r["line_no"], r["word"]): r["weight"] for r in rows} == pytest.approx(want, abs=1e-12)


def test_idf_counts_lines_without_sorting(spark):
    table = tokens_table(spark, ["a a b", "a c", "", "b"])
    found = terms.inverse_doc_frequency(table)
    want = terms.term_stats(table).select("word", "c_d", "i_d", "idf").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    assert "sort_array" not in plan_of(found) and "ReusedExchange" in plan_of(found)


def test_token_counts_and_masks_stay_plain(spark):
    """Counting sorts no line, and a mask's padding is written, not built."""
    counts = vocab.token_counts(tokens_table(spark, ["b a b", "", "c a"]))
    assert "sort_array" not in plan_of(counts)
    place = 10**9
    want = {("a", 2, place + 1), ("b", 2, place), ("c", 1, 3 * place)}
    assert {(r["token"], r["cnt"], int(r["first"])) for r in counts.collect()} == want
    plan = plan_of(QUERIES["attention_mask"](spark, "/root/testdata/sf0.001"))
    assert "array_repeat" not in plan


def test_sent_queries_hold_their_best_only(monkeypatch):
    """A task holds and gives out bounded lists, however many targets come; they equal one big product."""
    import types

    import pandas as pd

    rng = np.random.default_rng(4)
    q, t = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (500, 4)).astype(float)
    monkeypatch.setattr(vectors, "SENT_BACK", 7)
    monkeypatch.setattr(vectors, "PRODUCT_CELLS", 64)
    frames = [pd.DataFrame({"t_id": np.arange(x, x + 50), "t_vec": list(t[x : x + 50])}) for x in range(0, 500, 50)]
    sent = types.SimpleNamespace(value=(np.arange(30), vectors._unit(q)))
    out = list(vectors._sent_batches(sent, 6)(iter([frames[0][:0], *frames])))
    assert max(map(len, out)) == 7 * 6
    sims = np.round(vectors._unit(q) @ vectors._unit(t).T, vectors.COS_DIGITS)
    want = [(i, j, sims[i, j]) for i in range(30) for j in np.lexsort((np.arange(500), -sims[i]))[:6]]
    got = [tuple(r) for frame in out for r in frame.itertuples(index=False)]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert not list(vectors._sent_batches(sent, 6)(iter([frames[0][:0]])))


def test_bleu_moves_lines_to_python_once(spark):
    """Coding, decoding and matching are one kernel; they were three, with the words sent to each."""
    plan = evaluation.bleu_sentence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_recoded_words_are_those_of_coding_and_decoding(spark):
    rows = [(0, ["a", "b", "x"]), (1, ["x"]), (2, []), (3, None), (4, ["b", "b", "a", "y", "b"])]
    lines = spark.createDataFrame(rows, "k int, tokens array<string>")
    words = spark.createDataFrame([("a", 4, 3), ("b", 5, 2)], "token string, id int, cnt long")
    decoded = encode.decode_ids(encode.encode_tokens(lines, words, ["k"]), words, ["k"])
    both = lines.mapInArrow(encode.inline_recoder(words), "k int, cand array<string>, tokens array<string>")
    assert {r["k"]: " ".join(r["cand"]) for r in both.collect()} == {r["k"]: r["text"] for r in decoded.collect()}
    assert {r["k"]: r["tokens"] for r in both.collect()} == dict(rows)
    assert encode.inline_recoder(words, inline=1) is None


@pytest.mark.parametrize("most", [1, 50, 1 << 16])
def test_bleu_counts_in_parts(most):
    rng = random.Random(4)
    side = lambda: pa.array([[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(90)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([side(), side()], names=["c", "r"])
    (found,) = evaluate._match_batches(4, most)(iter([batch]))
    for i, row in enumerate(zip(batch["c"].to_pylist(), batch["r"].to_pylist())):
        for n in range(4):
            c, r = ([tuple(x[j : j + n + 1]) for j in range(len(x) - n)] for x in row)
            assert found.column(n)[i].as_py() == sum(min(c.count(g), r.count(g)) for g in set(c))
            assert found.column(4 + n)[i].as_py() == len(c)
