"""Alignment of two tokenizers over the bytes of each text.

A text, with a space in front, is encoded by a byte-level BPE (A) and by a piece BPE with
byte fallback (B). Both leave the bytes unchanged, so a token is a range of bytes, and the
places where tokens of both end cut a text into groups.

A batch of texts is one run of bytes in Arrow. It is cut into pieces in front of single
spaces, where neither vocabulary has a token across the cut: a piece has the same tokens
alone as in its text. Each distinct piece of the batch is encoded once. Token ids stay
lists: flattened, with parent indices, running sums of their byte lengths give every
token's end as one key of piece and place; a full outer hash join on the keys finds the
common ends, and the sorted keys, each with the token of either side that reaches over it,
are the links. Texts then take the rows of their pieces. ``Table.group_by`` counts the
distinct pairs of a document, then the documents of a pair, and Spark adds up what the
batches found.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ..operators.joins import lookup_join
from ..runtime import materialize
from .tokens import PATTERN
from .words import text_bytes

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 3 << 20
RUN_BYTES = 16 << 10
SPACE = 0x20
MARK = "▁"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
FOUND = f"{COLUMNS}, pairs array<long>, counts array<int>"

# A byte that can't begin a white-space character: printable ASCII, or the first byte of
# a character of several bytes in a block without white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC2:] = True
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        spec = json.loads(byte_level)
        alphabet, special = byte_alphabet(), {t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
        bytes_a = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        byte_pre = pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.a = tokenizers.Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        # Where ids follow the order of merges, a rank encoder has the same result and less to do.
        ranked = byte_pre and merged == sorted(merged) and spec["normalizer"] is None
        self.ranks = ranked and tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks={x: i for i, x in bytes_a.items()}, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        rules = sentencepiece_model_pb2.ModelProto.FromString(pieces).normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
        inner = any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(len(bytes_b)))
        self.cuts = bool(byte_pre and plain and not inner)  # else a text is one piece
        self.bytes_a = pa.array([bytes_a.get(i, b"") for i in range(max([*bytes_a, *special]) + 1)], pa.large_binary())
        self.bytes_b = pa.array(bytes_b, pa.large_binary())
        self.length_a, self.length_b = (pc.binary_length(x) for x in (self.bytes_a, self.bytes_b))

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a text that begins with the added space; None where bytes differ."""
        a = self.ranks.encode_ordinary(text) if self.ranks else self.a.encode(text, add_special_tokens=False).ids
        sides = np.array(a, np.int32), np.array(self.b.encode(text[1:]), np.int32)
        want = np.frombuffer(text.encode(), np.uint8)
        for table, ids in zip((self.bytes_a, self.bytes_b), sides):
            joined = table.take(pa.array(ids)).buffers()[2]
            if joined is None or not np.array_equal(np.frombuffer(joined, np.uint8), want):
                return None
        return sides

    def encode(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Lists of ids of both sides for each piece; empty lists where bytes differ.

        Pieces that could follow one another in a text are encoded as one text, which is
        then divided at their ends.
        """
        data, offsets = text_bytes(pieces)
        n = len(offsets) - 1
        alone = np.ones(n, bool)
        if self.cuts and n:
            starts = offsets[:-1]
            follows = (data[np.maximum(starts - 1, 0)] != SPACE) & _SOLID[data[np.minimum(starts + 1, len(data) - 1)]]
            alone = ~(follows & (np.diff(starts // RUN_BYTES, prepend=-1) == 0))
        flat: tuple[list, list] = ([], [])
        sizes = np.zeros((2, n), np.int64)
        borders = np.append(np.flatnonzero(alone), n)
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            runs = [(low, high)]
            found = self.ids(data[offsets[low] : offsets[high]].tobytes().decode())
            if found is None and high > low + 1:
                runs = [(i, i + 1) for i in range(low, high)]
            for first, last in runs:
                if len(runs) > 1:
                    found = self.ids(data[offsets[first] : offsets[last]].tobytes().decode())
                for side, lengths in enumerate((self.length_a, self.length_b)) if found is not None else ():
                    ends = np.cumsum(lengths.take(pa.array(found[side])).to_numpy())
                    upto = np.searchsorted(ends, offsets[first + 1 : last + 1] - offsets[first], side="right")
                    sizes[side, first:last] = np.diff(upto, prepend=0)
                    flat[side].append(found[side])
        return tuple(
            pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(sizes[side])), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *flat[side]]))
            )
            for side in (0, 1)
        )


def cut_pieces(texts: pa.Array, cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the texts, each with the space in front, and the number of pieces of each text."""
    text = pa.large_string()
    spaced = pc.binary_join_element_wise(pa.scalar(" ", text), texts.cast(text), pa.scalar("", text))
    data, offsets = text_bytes(spaced)
    starts = offsets[:-1]
    if cuts and len(data):
        before, after = np.empty_like(data), np.empty_like(data)
        before[0], before[1:] = SPACE, data[:-1]
        after[-1], after[:-1] = SPACE, data[1:]
        good = (data == SPACE) & (before != SPACE) & _SOLID[after]
        good[starts] = True
        starts = np.flatnonzero(good)
    ends = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces, np.diff(np.searchsorted(starts, offsets))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of consecutive ranges, one after another."""
    if not len(sizes):
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return shift + np.arange(len(shift))


def _texts_of(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Decimal ids joined by commas up to each end."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids.cast(pa.string()))
    return pc.binary_join(lists, ",")


def align(a: pa.Array, b: pa.Array, length_a: pa.Array, length_b: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """Links and groups of pieces, given as lists of ids of both sides.

    ``a``, ``b``: the ids of each link, in order, and ``links`` how many each piece has;
    ``text``: each piece's groups as text, ``groups`` how many.
    """
    sides = []
    for lists, lengths in ((a, length_a), (b, length_b)):
        ids = pc.list_flatten(lists)
        key = pc.cumulative_sum(lengths.take(ids))  # pieces lie end to end, with as many bytes on both sides
        sides.append((ids, key, pc.list_parent_indices(lists)))
    (ids_a, key_a, piece_a), (ids_b, key_b, _) = sides
    left = pa.table({"end": key_a, "a": ids_a, "piece": piece_a, "place_a": np.arange(len(ids_a))})
    right = pa.table({"end": key_b, "b": ids_b, "place_b": np.arange(len(ids_b))})
    both = left.join(right, "end", join_type="full outer", use_threads=False, coalesce_keys=True).sort_by("end")
    both = both.combine_chunks()
    common = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    piece = pc.fill_null_backward(both["piece"]).combine_chunks().to_numpy(zero_copy_only=False)
    found = {"a": pc.fill_null_backward(both["a"]).combine_chunks(), "b": pc.fill_null_backward(both["b"]).combine_chunks()}
    found["links"] = np.bincount(piece, minlength=len(a)) if len(piece) else np.zeros(len(a), np.int64)
    cut = both.filter(common)
    group_piece = cut["piece"].to_numpy()
    found["groups"] = np.bincount(group_piece, minlength=len(a)) if len(group_piece) else np.zeros(len(a), np.int64)
    found["text"] = pc.binary_join_element_wise(
        _texts_of(ids_a, cut["place_a"].to_numpy() + 1), _texts_of(ids_b, cut["place_b"].to_numpy() + 1), "|"
    )
    return found


def _take_lists(values, sizes: np.ndarray, pick: np.ndarray):
    """Values of the picked lists, one after another, and the picked sizes."""
    starts = np.append(0, np.cumsum(sizes)[:-1])
    index = _ranges(starts[pick], sizes[pick])
    return values.take(pa.array(index)), sizes[pick]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return np.diff(np.append(0, total[ends]))


def _aligned(coder: Coder, ids: pa.Array, texts: pa.Array) -> tuple[pa.RecordBatch, pa.Table]:
    """The documents of a slice, and how many of them hold each pair."""
    pieces, per_text = cut_pieces(texts.fill_null(""), coder.cuts)
    coded = pieces.dictionary_encode()
    a, b = coder.encode(coded.dictionary)
    made = align(a, b, coder.length_a, coder.length_b)
    size_a, size_b = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (a, b))

    index = coded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(per_text)
    whole = pc.greater(pc.binary_length(pc.fill_null(texts, "").cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    whole = whole & (_sums((size_a[index] == 0).astype(np.int64), ends) == 0)  # no text, or bytes differ
    kept = np.repeat(whole, per_text)
    index, per_text = index[kept], np.where(whole, per_text, 0)
    ends = np.cumsum(per_text)

    radix = len(coder.bytes_b)
    link_pairs = pc.add(pc.multiply(made["a"].cast(pa.int64()), radix), made["b"].cast(pa.int64()))
    pairs, per_piece = _take_lists(link_pairs, made["links"], index)
    n_links = _sums(per_piece, ends)
    links = pa.table({"doc": np.repeat(np.arange(len(ids)), n_links), "pair": pairs})
    counted = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    partial = counted.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pair_ends = np.append(0, np.searchsorted(counted["doc"].to_numpy(), np.arange(len(ids)), side="right"))

    groups, per_group = _take_lists(made["text"], made["groups"], index)
    n_groups = _sums(per_group, ends)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), pa.int32()), groups), ";")
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() if good else "" for x, good in zip(joined, whole)]

    offsets = pa.array(pair_ends.astype(np.int32))
    batch = pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(_sums(size_a[index], ends)),
            pa.array(_sums(size_b[index], ends)),
            pa.array(n_groups),
            pa.array(n_links),
            pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(offsets, counted["pair"].combine_chunks()),
            pa.ListArray.from_arrays(offsets, counted["count_all"].combine_chunks().cast(pa.int32())),
        ],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"],
    )
    return batch, partial


_CODERS: dict[bytes, Coder] = {}  # by digest of the two files


def _coder(byte_level: bytes, pieces: bytes) -> Coder:
    key = hashlib.blake2b(byte_level).digest() + hashlib.blake2b(pieces).digest()
    if key not in _CODERS:
        _CODERS[key] = Coder(byte_level, pieces)
    return _CODERS[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of a few megabytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def _batches(byte_level, pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(byte_level.value, pieces.value)
        for batch in batches:
            partials = []
            for low, high in _slices(batch.column("text")):
                part = batch.slice(low, high - low)
                rows, partial = _aligned(coder, part.column("doc_id"), part.column("text"))
                partials.append(partial)
                yield rows
            if not partials:
                continue
            held = pa.concat_tables(partials).group_by("pair", use_threads=False).aggregate([("count_all", "sum")]).combine_chunks()
            none = [pa.nulls(1, t) for t in (pa.int64(),) * 5]
            offsets = pa.array([0, len(held)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *none,
                    pa.nulls(1, pa.string()),
                    pa.ListArray.from_arrays(offsets, held["pair"].combine_chunks().cast(pa.int64()) if len(held) else pa.array([], pa.int64())),
                    pa.ListArray.from_arrays(offsets, held["count_all_sum"].combine_chunks().cast(pa.int32()) if len(held) else pa.array([], pa.int32())),
                ],
                names=rows.schema.names,
            )

    return run


def _file(spark, path: str):
    """The content of a vocabulary file, read by Spark; its size is that of the vocabulary."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def aligned_documents(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> tuple[DataFrame, DataFrame, int]:
    """(rows, pairs, radix): the aligned documents, and the documents that hold each pair.

    ``rows``: doc_id, rid, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    pairs of linked ids with their links in the document (pairs, counts). ``pairs``: pair,
    docs, best (whether no pair of the same A id is held by more documents). A pair is
    ``a * radix + b``.
    """
    spark = docs.sparkSession
    a, b = (spark.sparkContext.broadcast(_file(spark, path)) for path in (byte_level, pieces))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = slim.mapInArrow(_batches(a, b), FOUND).withColumn("rid", F.monotonically_increasing_id())
    written = materialize(found, "aligned")
    radix = sentencepiece.SentencePieceProcessor(model_proto=b.value).get_piece_size()
    partial = written.filter("n_a IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    held = partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / radix)))  # as many rows as B has pieces, at most
    pairs = materialize(held.select("pair", "docs", (F.col("docs") == most).alias("best")), "pairs")
    return written.filter("n_a IS NOT NULL"), pairs, radix


def alignment_report(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, limit: int = 1_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``docs`` has doc_id and text; further columns are ignored. A null or empty text, and
    one whose tokens of either side don't give back its bytes, has no tokens: zeros and an
    empty digest; it counts for no pair. Repeated rows stay rows of their own and count as
    documents of their own. The counts of pairs go to all tasks up to ``limit`` rows (and
    a byte bound); beyond, the most frequent pairs do and the others are joined by a
    shuffle.
    """
    rows, pairs, _ = aligned_documents(docs, byte_level, pieces)
    each = rows.select("rid", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    each = each.select("rid", F.col("p.pairs").alias("pair"), F.col("p.counts").cast("long").alias("n"))
    known = lookup_join(each, pairs, "pair", ["docs", "best"], hot_by="docs", limit=limit)
    sums = known.groupBy("rid").agg(
        F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
    )
    none = F.lit(0).cast("long")
    return rows.join(sums, "rid", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )
