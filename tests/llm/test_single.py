"""Token counts, language, urls, chat, quality, sharding, mixing: brute force and odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from lexiloom.llm import language, quality, tokens
from lexiloom.llm.chat import CHAT, escape, read_back, segments, unescape
from lexiloom.llm.mixing import SHARE, budgeted, mix_report, mixed, rake
from lexiloom.llm.quality import ORDER, START, SYMBOLS, accepted, gram_bits, placed, quality_verdicts, scored, slice_bits, train
from lexiloom.llm.shards import Runs, shard_rows
from lexiloom.llm.urls import RULES, judge_urls
from lexiloom.llm.words import text_bytes
from lexiloom.operators.joins import lookup_join

SF = "/root/testdata/sf0.001"
LONG = "é" * 200_000 + " The end."


def frame(spark, rows):
    """Documents with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("tokens", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("weight", F.lit(None).cast("int"))


# --- token counts ---------------------------------------------------------------------


def test_token_counts(spark):
    texts = ["The end.", "", None, "a  b\n\nc", "The end.", "naïve Élan 123 $$$", LONG, "'s it's"]
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    coder = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    lengths = sorted(len(coder.encode_ordinary(t or "")) for t in texts)
    rows = tokens.context_totals(tokens.length_histogram(df), block=4).collect()
    assert {r["tokens"]: r["docs"] for r in rows} == dict(collections.Counter(lengths))
    for r in rows:
        n = r["tokens"]
        assert r["docs_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["docs_upto"] == sum(x <= n for x in lengths)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["share_upto"] == pytest.approx(r["docs_upto"] / len(lengths))
    totals = tokens.context_totals(tokens.length_histogram(df))
    cut = {r["limit"]: (r["docs_cut"], r["truncated_total"]) for r in tokens.at_limits(totals, [0, 3, 10**6]).collect()}
    assert cut == {k: (sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in (0, 3, 10**6)}
    found = {r["share"]: r["tokens"] for r in tokens.quantiles(totals, [0.5, 1.0]).collect()}
    assert found == {0.5: lengths[3], 1.0: lengths[-1]}
    assert tokens.context_totals(tokens.length_histogram(df.filter("false"))).count() == 0


def test_token_counts_match_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(50).collect()]
    coder = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    for t in texts:
        assert coder.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids


# --- language -------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify_languages(docs).collect()
    truth = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    assert len(rows) == len(truth)
    learned = {lang for _, lang in truth.values()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in learned and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][1] for r in held) >= 0.9 * len(held)


def test_language_by_hand(spark):
    dictionaries = {"aa": b"the cat sat on the mat and the dog", "bb": b"le chat est sur la table et le chien"}
    texts = ["the cat and the dog sat", "le chien est sur la table", None, "", " 12 $ ", LONG, "the dog le chien"]
    df = frame(spark, [(i, t, "aa", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in language.predict_language(df, dictionaries).collect()}
    made = []
    for raw in dictionaries.values():
        one = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=one, write_content_size=False, write_checksum=False, write_dict_id=False))
    for i, t in enumerate(texts):
        if not t or not regex.search(r"\p{L}", t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
            continue
        raw = language.plain(t)
        chunks = [raw[x : x + language.CHUNK_BYTES] for x in range(0, len(raw), language.CHUNK_BYTES)]
        size = [sum(len(c.compress(x)) for x in chunks) for c in made]
        assert got[i]["lang_pred"] == ("aa", "bb")[size.index(min(size))]
        assert got[i]["accepted"] == (max(size) >= min(size) * (1 + language.MARGIN))
    assert got[0]["lang_pred"] == "aa" and got[1]["lang_pred"] == "bb"
    assert {r["lang_pred"] for r in language.predict_language(df, {}).collect()} == {"und"}


def test_language_learns_nothing_from_held_out(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "zz zz zz" if i in set(held) else "the cat", "no" if i in set(held) else "aa", "s") for i in range(400)]
    rows += [(500, None, "aa", None), (None, "the cat", "aa", None), (501, "the cat", None, None)]
    assert list(language.train(frame(spark, rows))) == ["aa"]
    got = language.identify_languages(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"aa", "und"}
    assert language.identify_languages(frame(spark, rows).filter("false")).count() == 0


# --- urls -----------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12?x#y", "http://xexample.org/en/1",
        "http://example.com/fr/1", "http://m.example.com/de/5", "https://com/de/", "http://org", "http://org/", None, "",
        "no scheme.org/", "x://y://org/", "http://u@example.com:80/fr/", "http://example.com#/fr/", "http://É.ORG/\n/a",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in judge_urls(df).collect()}
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [
            (len(rule), rule, said) for said, rule in RULES
            for name, start in [(rule[: rule.index("/")], rule[rule.index("/") :])]
            if (host == name or host.endswith("." + name)) and path.startswith(start)
        ]
        rule, said = max(fits)[1:] if fits else (None, None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == said if said else got[i]["verdict"] in ("allow", "block")
    assert len(got) == len(urls)
    assert judge_urls(df.filter("false")).count() == 0


def test_url_templates(spark):
    rows, labels = [], []
    for i in range(400):
        section = ("good", "bad", "plain", "other")[i % 4]
        rows.append((i, f"http://site.net/{section}/{i}/page"))
        if section in ("good", "bad") and i < 300:
            labels.append((i, int(section == "bad")))
    rows += [(1000 + i, f"http://wide.net/w{i}x/start") for i in range(100)] + [(2000, "http://deep.net" + "/a" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(df, [], spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(rows)
    assert {got[i]["verdict"] for i in range(400) if i % 4 == 1} == {"block"}
    assert {got[i]["verdict"] for i in range(400) if i % 4 != 1} == {"allow"}
    assert got[0]["template"] == "/good/{n}/page" and got[1]["template"] == "/bad/{n}/page"
    assert {got[i]["template"] for i in range(400) if i % 4 > 1} == {"/*/{n}/page"}  # no label sets them apart
    assert {got[1000 + i]["template"] for i in range(100)} == {"/*/start"}  # many words in one place
    labelled = [got[i] for i in range(400) if i % 4 == 1]
    assert labelled[0]["labelled"] == 75 and 0 < labelled[0]["purity"] < 0.5


# --- chat -----------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(1)
    parts = ["\\", "### ", "</turn>", "#", "<", "/turn>", "\n", "a", "é", "😀", ":", "### Assistant:\n", "\n</turn>\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text
        role = "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
        header = CHAT.header(role)
        assert CHAT.role(header[len(CHAT.opening) : -len(CHAT.named)]) == role


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", None), (1, 3, "assistant", "### x </turn>"),
        (2, 5, "system", "s"), (2, 7, "user", "\\"), (2, 9, "assistant", "\\\\</turn>\n### User:\n"),
        (3, 0, "assistant", "first"), (4, 0, "user", "no answer"), (5, 0, None, "odd"), (5, 1, "a:\\\nb", "</turn>"),
        (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 0, "assistant", "tie"), (None, 0, "user", "x"),
        (7, 0, "user", LONG), (7, 1, "assistant", LONG), (8, 0, "User", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    got = {r["conv_id"]: r for r in read_back(segments(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        learned = "".join(text for _, role, text in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), digest)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        text = "".join(CHAT.header(role) + escape(text) + CHAT.closing for _, role, text in own)
        assert r["formatted_chars"] == len(text)
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, None: False, 7: True, 8: False}
    assert read_back(segments(df.filter("false"))).count() == 0


def test_chat_segments(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "### b")], "conv_id long, turn long, role string, text string")
    rows = [(r["part"], r["text"], r["loss"]) for r in segments(df).collect()]
    assert rows == [
        ("open", "### User:\n", False), ("text", "a", False), ("close", "\n</turn>\n", False),
        ("open", "### Assistant:\n", False), ("text", "\\### b", True), ("close", "\n</turn>\n", False),
    ]


# --- quality --------------------------------------------------------------------------


def brute_model(texts):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""
    start = [START] * (ORDER - 1)
    counts = {ORDER: collections.Counter()}
    for t in texts:
        x = start + list(t.encode())
        counts[ORDER].update(tuple(x[i : i + ORDER]) for i in range(len(x) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    taken = {}
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else y * i for i in (1, 2, 3)]
        taken[k] = [min(max(d, 0.1), i - 0.1) for i, d in zip((1, 2, 3), found)]
    contexts = {k: collections.defaultdict(lambda: [0, 0.0]) for k in counts}
    for k, table in counts.items():
        for g, c in table.items():
            own = contexts[k][g[:-1]]
            own[0] += c
            own[1] += taken[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / SYMBOLS
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        whole, left = contexts[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (c - taken[k][min(c, 3) - 1] if c else 0) / whole + left / whole * p(g[1:])

    def bits(text):
        x = start + list(text.encode())
        return sum(-math.log2(p(tuple(x[i : i + ORDER]))) for i in range(len(x) - ORDER + 1))

    return p, bits


def test_quality_model(spark):
    texts = ["The cat sat on the mat. The cat!", "le chat, été 1999", "", "a", "the the the 12 34"]
    df = frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)] + [(9, None, None, None)])
    model = train(df)
    p, bits = brute_model(texts)
    rng = random.Random(2)
    known = [t.encode()[i : i + ORDER] for t in texts for i in range(len(t.encode()) - ORDER + 1)]
    asked = {bytes(rng.choice(b"the cat\n\xc31") for _ in range(ORDER)) for _ in range(400)} | set(known) | {b"\xff" * ORDER}
    grams = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in asked], "gram long")
    found = {r["gram"].to_bytes(ORDER, "big"): r["bits"] for r in gram_bits(grams, model).collect()}
    assert found.keys() == asked
    assert all(found[g] == pytest.approx(-math.log2(p(tuple(g))), rel=1e-9) for g in asked)
    sums = [sum(p((*b"cat ", c)) for c in range(SYMBOLS)), sum(p((*b"zzzz", c)) for c in range(SYMBOLS))]
    assert sums == pytest.approx([1, 1])


@pytest.mark.parametrize("bound", [2, 1_000_000])
def test_quality_scores(spark, monkeypatch, bound):
    """Whole texts in slices of their file, lookups by broadcast and by shuffled joins."""
    monkeypatch.setattr(quality, "lookup_join", lambda *a: lookup_join(*a, limit=bound))
    texts = ["The cat sat on the mat. The cat!", "le chat, été 1999", "", "a", "the the the 12 34"]
    _, bits = brute_model(texts)
    asked = [*texts, LONG * 4, None, "$$$ unseen ÿ", LONG * 4, "a"]
    model = train(frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)] + [(9, None, None, None)]))
    rows = placed(frame(spark, [(i, t, None, None) for i, t in enumerate(asked)]))
    assert rows.select("_slice").distinct().count() > 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = scored(rows.select("_slice", "doc_id", "text"), slice_bits(rows, model)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["doc_id"] for r in got) == list(range(len(asked)))
    for r in got:
        text = asked[r["doc_id"]] or ""
        assert r["_bits"] == pytest.approx(bits(text), rel=1e-5)
        assert r["_bytes"] == len(text.encode())


def test_quality_largest_table_stays(spark, monkeypatch):
    """The n-grams of the highest order are never a lookup table, which may be sent; shorter ones are, four times."""
    model = train(frame(spark, [(i, f"some text {i} or other", "en", None) for i in range(20)]))
    asked = []
    monkeypatch.setattr(quality, "lookup_join", lambda left, table, *a: asked.append(set(table.inputFiles())) or lookup_join(left, table, *a))
    grams = [int.from_bytes(g, "big") for g in (b"some ", b"xsome", b"qqqqq", b"other", b"other")]
    got = gram_bits(spark.createDataFrame([(g,) for g in grams], "gram long"), model)
    assert len(got.collect()) == 4
    assert len(asked) == 4 and not any(files & set(model[ORDER][0].inputFiles()) for files in asked)


def test_quality_pieces():
    """N-grams of a piece-wise read batch are those of the whole texts; full tables are given out."""
    texts = ["", "ab" * 400_000, "é", "x" * 10, None, "yz" * 300_000]
    data, offsets = text_bytes(pa.array(texts))
    found = collections.defaultdict(list)
    for first, grams, counts in quality._grams(data, offsets):
        for row, part in enumerate(np.split(grams, np.cumsum(counts)[:-1])):
            found[first + row] += part.tolist()
    for i, t in enumerate(texts):
        x = bytes([START]) * (ORDER - 1) + (t or "").encode()
        assert found[i] == [int.from_bytes(x[j : j + ORDER], "big") for j in range(len(x) - ORDER + 1)]


def test_quality_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_verdicts(docs, labels).collect()}
    assert len(rows) == docs.count()
    said = {r["doc_id"]: r for r in labels.collect()}
    good = [i for i, r in said.items() if r["quality"] == 1]
    bad = [i for i, r in said.items() if r["quality"] == 0]
    assert sum(rows[i]["accepted"] for i in good) >= 0.95 * len(good)
    assert sum(not rows[i]["accepted"] for i in bad) >= 0.8 * len(bad)


def test_quality_odd_rows(spark):
    rows = [(i, f"the cat {i}", "en", None) for i in range(30)] + [(40, None, "en", None), (41, "", None, None), (1, "the cat 1", "en", None), (None, "the", "xx", None)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_verdicts(df, labels).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["accepted"]} >= {40, 41}
    want = sorted(repr((r["doc_id"], r["lang"])) for r in got if r["accepted"])
    for bound in (0, 100):
        kept = accepted(df, labels, bound)
        assert kept.columns == df.columns
        assert sorted(repr((r["doc_id"], r["lang"])) for r in kept.collect()) == want
    assert all(r["accepted"] for r in quality_verdicts(df.filter("text != ''"), labels.filter("false")).collect())
    assert accepted(df.filter("false"), labels).count() == 0


# --- sharding -------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
        capacity += 1


def test_capacity_is_minimal():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))), reverse=True)
        runs = sorted(collections.Counter(sizes).items(), reverse=True)
        made = Runs(np.array([s for s, _ in runs]), np.ones(len(runs), np.int64), np.array([n for _, n in runs]))
        shards = rng.randrange(1, 8)
        assert made.capacity(0, shards) == brute_capacity(sizes, shards)
        cuts = [0, *made.cuts(shards), len(sizes)]
        parts = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert sum(parts) == sum(sizes) and max(parts) <= brute_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 5, 40, 500])
def test_shards(spark, shards):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(0, 300) + "é" * rng.randrange(3), None, None) for i in range(300)]
    rows += [(1000 + i, "copy", None, None) for i in range(80)] + [(2000, None, None, None), (2001, "", None, None), (5, "a", None, None), (5, "a", None, None)]
    got = shard_rows(frame(spark, rows), shards).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    by_shard, by_text = collections.defaultdict(list), collections.defaultdict(set)
    texts = {i: t or "" for i, t, _, _ in rows}
    for r in got:
        by_shard[r["shard"]].append(r)
        by_text[texts[r["doc_id"]] if r["doc_id"] != 5 else r["size"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    assert set(by_shard) <= set(range(shards)) and all(len(s) == 1 for s in by_text.values())
    sizes = [sum(r["size"] for r in by_shard.get(s, [])) for s in range(shards)]
    if shards == 5:
        assert max(sizes) - min(sizes) <= 400


def test_shards_of_nothing(spark):
    assert shard_rows(frame(spark, [(1, "a", None, None)]).filter("false")).count() == 0


# --- mixing ---------------------------------------------------------------------------


def test_rake(spark):
    rng = random.Random(4)
    cells = [(s, l, t, rng.randrange(1, 100)) for s in "abc" for l in "de" for t in "xyz" if rng.random() < 0.9]
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"d": 0.6, "e": 0.4}, "topic": {"x": 0.2, "y": 0.3, "z": 0.5}}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame(list(x.items()), f"{d} string, target double") for d, x in want.items()}
    got = [r.asDict() for r in rake(df, targets, 1e-9, 200).collect()]
    weight = {(s, l, t): float(n) for s, l, t, n in cells}
    for _ in range(200):
        for place, d in enumerate(want):
            sums = collections.Counter()
            for k, w in weight.items():
                sums[k[place]] += w
            weight = {k: w * want[d][k[place]] / sums[k[place]] for k, w in weight.items()}
    assert {(r["source"], r["lang"], r["topic"]): pytest.approx(r["weight"], rel=1e-6) for r in got} == weight


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "bravo", "charlie", "x"]) for _ in range(rng.randrange(1, 9))), rng.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    rows += [(700, None, "en", "hot"), (701, " \n", None, None), (1, rows[1][1], rows[1][2], rows[1][3])]
    got = mix_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["probability"] <= 1 for r in got) and max(r["probability"] for r in got) == 1
    assert {(r["probability"], r["kept"], r["topic"]) for r in got if r["doc_id"] in (700, 701)} == {(0.0, False, "unknown")}
    for d, power in (("source", 0.8), ("lang", 0.9), ("topic", 0.9)):
        have, mixed = collections.Counter(), collections.Counter()
        for r in got:
            have[r[d]] += r["tokens"]
            mixed[r[d]] += r["tokens"] * r["probability"]
        have = {k: n for k, n in have.items() if n}
        goal = {k: n**power / sum(x**power for x in have.values()) for k, n in have.items()}
        for k in goal:
            assert mixed[k] / sum(mixed.values()) == pytest.approx(goal[k], abs=1e-4)
    assert mix_report(frame(spark, rows).filter("false")).count() == 0


def test_budgeted(spark):
    rng = random.Random(8)
    cells = [(s, l, t, rng.randrange(50, 100)) for s in "abc" for l in "de" for t in "xy"] + [("r", "e", "x", 3)]
    want = {"source": {"a": 0.3, "b": 0.3, "c": 0.2, "r": 0.2}, "lang": {"d": 0.5, "e": 0.5}, "topic": {"x": 0.5, "y": 0.5}}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame(list(x.items()), f"{d} string, target double") for d, x in want.items()}
    total = sum(c[3] for c in cells)
    for share in (0.2, 0.6, 1.0):
        got = budgeted(df, targets, share).collect()
        assert len(got) == len(cells) and all(0 < r["p"] <= 1 for r in got)
        assert sum(r["p"] * r["tokens"] for r in got) == pytest.approx(share * total)
        assert [r["p"] for r in got if r["source"] == "r"] == [1]  # less than its target: all of it
        if share == 0.2:
            sums = collections.Counter()
            for r in got:
                sums[r["source"]] += r["p"] * r["tokens"]
            rest = share * total - 3
            assert {k: pytest.approx(v, rel=1e-4) for k, v in sums.items() if k != "r"} == {"a": rest * 3 / 8, "b": rest * 3 / 8, "c": rest / 4}


def test_rare_document_keeps_the_size(spark):
    docs = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = spark.createDataFrame([(-1, "three added words", None, None)], docs.schema)
    kept = []
    for df in (docs, docs.union(rare)):
        got = mixed(df, drop=("text",)).collect()
        whole = sum(r["_tokens"] for r in got)
        assert sum(r["_tokens"] * r["_probability"] for r in got) == pytest.approx(SHARE * whole, rel=1e-6)
        kept.append(sum(r["_kept"] for r in got) / len(got))
    assert abs(kept[0] - kept[1]) < 0.01


def test_many_cells_give_what_few_give(spark, monkeypatch):
    """Sums by window and by join agree, and unmet targets are reported."""
    from lexiloom.llm import mixing

    rows = [(f"s{i % 4}", f"l{i % 3}", f"t{i % 5}", 7 * i % 31 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    df = df.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    targets = {d: mixing.tempered(df, d, 0.5) for d in mixing.DIMENSIONS}
    found = []
    for few in (mixing.FEW_CELLS, 0):
        monkeypatch.setattr(mixing, "FEW_CELLS", few)
        found.append([{(r["source"], r["lang"], r["topic"]): r[c] for r in part.collect()} for part, c in (
            (rake(df, targets), "weight"), (budgeted(df, targets, 0.6), "p"))])
    for a, b in zip(*found):
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    apart = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    unmet = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"),
             "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double")}
    with pytest.warns(UserWarning, match="targets not met"):
        rake(apart, unmet, rounds=4)
