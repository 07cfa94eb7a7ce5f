"""Removal of repeated word windows against a plain version."""

import hashlib
import random
import re

import pytest

from lexiloom.llm.substrings import without_repeats


def brute(rows, window):
    """(doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256 of the kept words)"""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    seen, out = set(), []
    for doc, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone.update(range(i, i + window))
            seen.add(own)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=4):
    odd = [(*r, 1, 2, "x") for r in rows]
    return spark.createDataFrame(odd, "doc_id long, text string, rid int, start int, packed string").repartition(parts)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def corpus(n, seed):
    """Texts over few words, with a passage in a third, copies, near copies and loops."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(n):
        words = [rng.choice("abcdefgh") + rng.choice("xyzXY") + str(rng.randrange(60)) for _ in range(rng.randrange(90))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(5) : rng.randrange(30, 41)]
        if i % 7 == 0 and out:
            words = (out[rng.randrange(len(out))][1] or "").split()
            if i % 2 and words:
                words[rng.randrange(len(words))] = "changed"
        if i % 29 == 0:
            words = ["loop", "over", "it"] * 30
        out.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    return out


ODD = [(7, "dup " * 30), (7, "dup " * 30), (7, "other " * 3), (None, "a b c " * 20), (None, None), (1, ""), (2, " \n\t "), (3, None)]
ODD += [(10, "w" * 5000), (11, " ".join(map(str, range(60_000)))), (12, "é " + " ".join(map(str, range(500, 900))) + " ü")]


@pytest.mark.parametrize("hot,bits", [(4096, 27), (3, 27), (0, 3)])
def test_against_plain_version(spark, hot, bits):
    rows = corpus(300, 1)
    assert found(without_repeats(frame(spark, rows), 20, 5, hot, bits)) == brute(rows, 20)


@pytest.mark.parametrize("window,run", [(20, 5), (4, 2), (3, 3), (1, 1)])
def test_odd_rows_and_windows(spark, window, run):
    rows = ODD + corpus(80, 2)
    assert found(without_repeats(frame(spark, rows), window, run)) == brute(rows, window)


def test_both_joins_give_the_same(spark):
    rows = corpus(120, 3)
    for broadcast in (True, False):
        assert found(without_repeats(frame(spark, rows, 9), broadcast=broadcast)) == brute(rows, 20)


def test_text_and_empty_table(spark):
    rows = [(1, "a b\tc d"), (2, "x a b c d y")]
    kept = {r["doc_id"]: r["kept"] for r in without_repeats(frame(spark, rows), 4, 2, with_text=True).collect()}
    assert kept == {1: "a b c d", 2: "x y"}
    assert found(without_repeats(frame(spark, []))) == []
