"""The Merkle manifest against a plain version, with small runs and blocks so that trees get deep."""

import hashlib
import zlib

import pytest

from lexiloom.llm.merkle import folded, manifest, verified_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, rank int, path string, _at int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = []
    for value in row:
        text = None if value is None else str(value)
        out.append("-" if text is None else f"{len(text.encode())}:{text}")
    return digest(*out)


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves, fanout):
    """Root, and per leaf its list of (left, right) siblings."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, spot in enumerate(at):
            start = spot // fanout * fanout
            run = level[start : start + fanout]
            paths[i].append(("".join(run[: spot - start]), "".join(run[spot - start + 1 :])))
            at[i] = spot // fanout
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout=8, every=3):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in order:
        members = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[lang] = (members, *tree([leaf(r) for r in members], fanout))
    root, tops = tree([done[x][1] for x in order], fanout) if order else (None, [])
    out = []
    for lang, top in zip(order, tops):
        members, subroot, paths = done[lang]
        for row, path in zip(members, paths):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % every == 0
            now = leaf((*row[:4], lower(row[4]))) if tampered else leaf(row)
            for left, right in [*path, *top]:
                now = digest(left, now, right)
            proof = digest(*[x for pair in [*path, *top] for x in pair])
            out.append((row[0], leaf(row), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", 2) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = [(i, f"s{i % 3}", ["en", "fr", None, "a-é"][i % 4], 5 * i, ["Text", "low", "", None, "ÄB\n"][i % 5]) for i in range(75)]
CASES += [(3, "s0", "en", 1, "Same"), (3, "s0", "en", 1, "Same"), (3, "s0", "en", 1, "Other"), (None, None, None, None, None)]
CASES += [(None, "s", "en", 2, "X"), (500, "s", "alone", 1, "Long " * 60_000)]


@pytest.mark.parametrize("fanout,levels", [(8, 3), (2, 2), (3, 1)])
def test_against_plain_version(spark, fanout, levels):
    assert found(verified_manifest(frame(spark, CASES), 3, fanout, levels)) == brute(CASES, fanout)


def test_small_tables(spark):
    assert found(verified_manifest(frame(spark, CASES[:0]))) == []
    for n in (1, 2, 8, 9):
        rows = [(i, "s", "en", 1, "Text") for i in range(n)]
        assert found(verified_manifest(frame(spark, rows))) == brute(rows)


def test_tampering_is_found_and_proofs_hold(spark):
    rows = manifest(frame(spark, CASES)).select("doc_id", "leaf", "root", folded(leaf_column(), "path").alias("again"))
    assert all(r["again"] == r["root"] for r in rows.collect())
    verdicts = {r["doc_id"]: r["verified"] for r in verified_manifest(frame(spark, CASES)).collect() if r["doc_id"] != 3}
    hit = {i for i, *_, text in CASES if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text and text != lower(text)}
    assert {i for i, good in verdicts.items() if not good} == hit - {3}


def leaf_column():
    from pyspark.sql import functions as F

    return F.col("leaf")
