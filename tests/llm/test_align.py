"""Alignment of two tokenizers against whole texts encoded one by one."""

import collections
import hashlib

import pytest
import sentencepiece
import tokenizers

from lexiloom.llm import align
from lexiloom.llm.align import BYTE_LEVEL, MARK, PIECES, alignment_report, byte_alphabet

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(both, text):
    """(id, bytes) of either side, or None where the bytes are not those of the text."""
    a, b = both
    alphabet = byte_alphabet()
    sides = (
        [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [
            (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode())
            for i in b.encode(text)
        ],
    )
    return sides if all(b"".join(x for _, x in side) == (" " + text).encode() for side in sides) else None


def ends(side):
    at, out = 0, []
    for i, x in side:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def brute(both, rows):
    linked, groups, sizes = [], [], []
    for _, text in rows:
        found = tokens(both, text) if text else None
        a, b = (ends(x) for x in found) if found else ([], [])
        i = j = 0
        links = []
        while i < len(a) and j < len(b):
            links.append((a[i][2], b[j][2]))
            end = min(a[i][1], b[j][1])
            i, j = i + (a[i][1] == end), j + (b[j][1] == end)
        common = sorted({x[1] for x in a} & {x[1] for x in b})
        text_of, low = [], 0
        for c in common:
            text_of.append("|".join(",".join(str(i) for s, e, i in side if s >= low and e <= c) for side in (a, b)) if len(a) < 3000 else "")
            low = c
        linked.append(links)
        sizes.append((len(a), len(b), len(common), len(links)))
        groups.append(hashlib.sha256(";".join(text_of).encode()).hexdigest() if a else "")
    docs = collections.Counter(p for links in linked for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [
        (i, *size, sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), digest)
        for (i, _), links, size, digest in zip(rows, linked, sizes, groups)
    ]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b   ", "tab\tand\nline \n\n end\r\n", "x  y  z　 w", "naïve Köln señor",
    "<|endoftext|> and </s> <s> <unk> <0x41>", "the▁mark", "日本語 テスト \U0001f600 ok", "a\x00b", "don't I'll", "1234 5 67,8.9",
    "word " * 400, "long" * 2000, "The cat sat.", "The cat sat.", " The cat", "é ﬁ", "\u0085 x", " y  z",
]


def test_against_whole_texts(spark, both):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "The cat sat."), (None, "The dog sat."), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, rid int, pair string, n_a int")
    got = [tuple(r) for r in alignment_report(df.repartition(3)).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(both, rows), key=str)


def test_shuffled_lookup_gives_the_same(spark, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute(both, rows), key=str)
    for limit in (1_000_000, 10):
        assert sorted((tuple(r) for r in alignment_report(df, limit=limit).select(*COLUMNS).collect()), key=str) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_report(df).collect() == []


def test_pieces_have_the_tokens_of_their_text(both):
    import pyarrow as pa

    texts = [t for t in ODD if t]
    pieces, counts = align.cut_pieces(pa.array(texts), True)
    a, b = both
    at = 0
    for text, n in zip(texts, counts):
        own = pieces[at : at + n].to_pylist()
        at += n
        assert "".join(own) == " " + text
        assert sum((a.encode(p, add_special_tokens=False).ids for p in own), []) == a.encode(" " + text, add_special_tokens=False).ids
        assert sum((b.encode(p[1:]) for p in own), []) == b.encode(text)
