"""Language identification by compression with per-language zstandard dictionaries.

The dictionary of a language is raw content out of a bounded sample of labelled texts.
A text is cut into chunks, every chunk is compressed with each dictionary, and the
language with the fewest bytes over the whole text wins. A narrow margin to the second
is a rejection: the language is still named, ``accepted`` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

SAMPLE_DOCS = 256
PIECE_BYTES = 1024
DICTIONARY_BYTES = 32 << 10
CHUNK_BYTES = 1024
LEVEL = 5
MARGIN = 0.02
SHARPNESS = 40.0
HELD_OUT_PART, PARTS = 2, 4

_LETTER = regex.compile(r"\p{L}")
_SIGNS_TO_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case, with every run of ASCII characters but letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SIGNS_TO_SPACE).split())


def held_out():
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS == HELD_OUT_PART


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw dictionary content per language of ``docs`` (doc_id, text, lang).

    The sample is bounded: the ``sample_docs`` documents of a language with the smallest
    hashes of doc_id, and of each a piece of PIECE_BYTES from a place set by that hash.
    """
    usable = docs.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out())
    keyed = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("place"), "text")
    # Written, so that Spark sees how small it is and leaves the texts where they are.
    sizes = materialize(keyed.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    # Uniform hashes: a share of the range holds about twice the sample of each language.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_docs) / F.col("n"))
    cut = keyed.join(sizes, "lang").filter(F.abs(F.col("place") / F.lit(2.0**63)) <= share)
    first = F.pmod("place", F.greatest(F.length("text") - PIECE_BYTES, F.lit(1))).cast("int") + 1
    picked = materialize(cut.select("lang", "doc_id", "place", F.substr("text", first, F.lit(PIECE_BYTES)).alias("text")), "picked")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    rows = picked.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect()
    content: dict[str, list[bytes]] = {}
    for r in rows:
        content.setdefault(r["lang"], []).append(plain(r["text"]))
    found = {lang: b" ".join(pieces)[:DICTIONARY_BYTES] for lang, pieces in content.items()}
    return {lang: raw for lang, raw in sorted(found.items()) if raw.strip()}


def _compressors(dictionaries: dict[str, bytes]) -> list:
    found = []
    for raw in dictionaries.values():
        one = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one.precompute_compress(level=LEVEL)
        found.append(
            zstandard.ZstdCompressor(
                dict_data=one, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return found


def code_lengths(text: str, compressors: list) -> np.ndarray:
    """Compressed bytes of the whole text under each dictionary."""
    raw = plain(text)
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)] or [b""]
    return np.array([sum(len(c.compress(x)) for x in chunks) for c in compressors], np.float64)


def _predict_batches(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, compressors = list(dictionaries), _compressors(dictionaries)
        for batch in batches:
            named, score, accepted = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                if not langs or text is None or not _LETTER.search(text):
                    named.append("und"), score.append(0.0), accepted.append(False)
                    continue
                size = code_lengths(text, compressors)
                best = int(size.argmin())
                weights = np.exp(-SHARPNESS * (size - size[best]) / size[best])
                second = np.partition(size, 1)[1] if len(size) > 1 else np.inf
                named.append(langs[best])
                score.append(float(weights[best] / weights.sum()))
                accepted.append(bool(second >= size[best] * (1 + margin)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of ``docs`` (doc_id, text).

    Only the text is looked at. ``und`` stands for a null text, one without any letter,
    or no dictionary at all. Equal code lengths go to the language first in the alphabet
    and are not accepted. The dictionaries have a fixed size per language.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(
        _predict_batches(dictionaries, margin), "doc_id long, lang_pred string, score double, accepted boolean"
    )


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; learned from three quarters of ``docs``.

    A null doc_id is never learned from and not held out.
    """
    slim = docs.select("doc_id", "text", "lang")
    found = predict_language(slim, train(slim))
    return found.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
