"""Subword vocabulary: merge learning and greedy encoding."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import CLS, SEP
from ..runtime import discard, materialize, scratch_path, with_keys

# Special tokens of a subword vocabulary, ids 0 to 4.
PIECE_SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
MARK = "##"
# A symbol is stored between two of these, so replacing text cannot split a symbol.
EDGE = "␟"
# Pairs taken into a step at first and at most, and runs of symbols that may reach the driver.
START_PAIRS, MOST_PAIRS, MOST_FRAGMENTS = 64, 16_384, 100_000
# Words whose pieces a task keeps at hand.
HELD_WORDS = 500_000


def word_symbols(words: DataFrame, alphabet: DataFrame | None = None) -> DataFrame:
    """Distinct words and counts to rows of single-character symbols.

    Characters after the first carry the continuation mark. With ``alphabet`` given,
    other characters are dropped. The edge character itself is never part of a symbol.
    """
    chars = F.filter(F.split("word", ""), lambda c: (F.length(c) > 0) & (c != EDGE))
    if alphabet is not None:
        kept = words.select("word", "cnt", F.posexplode(chars).alias("pos", "ch")).join(
            F.broadcast(alphabet.select("ch")), "ch", "left_semi"
        )
        words = kept.groupBy("word", "cnt").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]).alias("chars")
        )
    else:
        words = words.withColumn("chars", chars)
    edge = F.lit(EDGE)
    symbols = F.transform(
        "chars", lambda c, i: F.concat(edge, F.when(i == 0, c).otherwise(F.concat(F.lit(MARK), c)), edge)
    )
    return words.select("cnt", F.concat_ws("", symbols).alias("symbols"))


def limit_alphabet(words: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent characters, weighted by word count."""
    chars = words.select("cnt", F.explode(F.split("word", "")).alias("ch"))
    return chars.filter((F.length("ch") > 0) & (F.col("ch") != EDGE)).groupBy("ch").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "ch").limit(size)


def pair_counts(symbols: DataFrame) -> DataFrame:
    """Weighted count of each pair of neighbouring symbols."""
    parts = F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), EDGE + EDGE, -1)
    neighbours = F.expr("transform(sequence(1, greatest(size(p) - 1, 1)), i -> struct(p[i - 1] AS a, p[i] AS b))")
    pairs = symbols.select("cnt", parts.alias("p")).filter(F.size("p") > 1).select(
        "cnt", F.explode(neighbours).alias("q")
    )
    return pairs.groupBy("q.a", "q.b").agg(F.sum("cnt").alias("cnt"))


def merged(a: str, b: str) -> str:
    return a + b.removeprefix(MARK)


def _split(symbols: str) -> list[str]:
    return symbols[1:-1].split(EDGE + EDGE) if symbols else []


def merge_once(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Join every neighbouring ``pair``, from left to right."""
    out, i, made = [], 0, merged(*pair)
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(made)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def merge_in_order(symbols: list[str], places: dict[tuple[str, str], list[int]]) -> list[str]:
    """Apply a list of merges, given as the places of each pair in it, one after another."""
    done = -1
    while True:
        found = [(r, p) for p in zip(symbols, symbols[1:]) for r in places.get(p, ()) if r > done]
        if not found:
            return symbols
        done, pair = min(found)
        symbols = merge_once(symbols, pair)


def _merge_batches(places: dict[tuple[str, str], list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column("symbols").to_pylist():
                symbols = merge_in_order(_split(text), places)
                made.append("".join(EDGE + x + EDGE for x in symbols))
            yield pa.RecordBatch.from_arrays([batch.column("cnt"), pa.array(made, pa.string())], names=["cnt", "symbols"])

    return run


def _fragment_batches(inside: set[tuple[str, str]]):
    """Runs of symbols whose neighbours are all pairs of the set, with their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for n, text in zip(batch.column("cnt").to_pylist(), batch.column("symbols").to_pylist()):
                symbols = _split(text)
                low = 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in inside:
                        if i - low > 1:
                            own = "".join(EDGE + x + EDGE for x in symbols[low:i])
                            found[own] = found.get(own, 0) + n
                        low = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.values(), pa.int64()), pa.array(found.keys(), pa.string())], names=["cnt", "symbols"]
            )

    return run


def merge_fragments(
    fragments: list[tuple[list[str], int]], floor: int, min_freq: int, room: int, known: set[str]
) -> list[tuple[str, str, int]]:
    """The merges that one-by-one training makes as long as the best pair is above ``floor``.

    Outside the fragments no pair is above the floor, and no merge makes one: a new pair
    is never more frequent than the one that it replaces. The one exception is a merge
    that makes a token which exists already, as counts of both then add up; it ends the list.
    """
    counts: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)

    def book(i: int, sign: int) -> None:
        symbols, n = fragments[i]
        for p in zip(symbols, symbols[1:]):
            counts[p] += sign * n
            where[p].add(i)

    for i in range(len(fragments)):
        book(i, 1)
    queue = [(-n, *p) for p, n in counts.items()]
    heapq.heapify(queue)
    found: list[tuple[str, str, int]] = []
    tokens = set(known)
    while queue and len(found) < room:
        n, a, b = heapq.heappop(queue)
        if -n != counts[a, b]:
            continue  # an entry of an earlier count
        if -n <= floor or -n < min_freq:
            break
        found.append((a, b, -n))
        changed = set()
        for i in where.pop((a, b)):
            symbols, weight = fragments[i]
            made = merge_once(symbols, (a, b))
            if len(made) != len(symbols):
                changed.update(zip(symbols, symbols[1:]), zip(made, made[1:]))
                book(i, -1)
                fragments[i] = (made, weight)
                book(i, 1)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(queue, (-counts[p], *p))
        if merged(a, b) in tokens:
            break
        tokens.add(merged(a, b))
    return found


def _leading_pairs(pairs: DataFrame, min_freq: int, look: int) -> tuple[list, int, int]:
    """The pairs above a count, that count, and how many pairs were looked at.

    Pairs of one count are taken together or not at all. Where the very first count has
    more pairs than are looked at, only its first pair is given, with its count as floor.
    """
    while True:
        top = pairs.filter(F.col("cnt") >= min_freq).orderBy(F.desc("cnt"), "a", "b").limit(look + 1).collect()
        if len(top) <= look:
            return top, 0, look
        above = [r for r in top if r["cnt"] > top[-1]["cnt"]]
        if above:
            return above, top[-1]["cnt"], look
        if look >= MOST_PAIRS:
            return top[:1], top[0]["cnt"], look
        look *= 4


def learn_merges(
    state: DataFrame, known: set[str], room: int, min_freq: int, most_fragments: int = MOST_FRAGMENTS
) -> Iterator[tuple[int, str, str, int]]:
    """(step, a, b, count) of the merges that one-by-one training makes, many in a step.

    ``state`` holds cnt and symbols of distinct words. In a step the leading pairs and the
    runs of symbols made of them only, summed over all words, go to the driver: at most
    ``most_fragments``, else fewer pairs are taken. All merges down to the count of the
    first pair left out follow from these; then the words are merged and written anew.
    ``known`` is extended by the new tokens, and training ends with ``room`` of them.
    """
    spark = state.sparkSession
    look, step, left, path = START_PAIRS, 0, room, None
    while left > 0:
        counted = materialize(pair_counts(state), "pairs")
        while True:
            top, floor, look = _leading_pairs(counted, min_freq, look)
            if not top:
                return
            if floor == top[0]["cnt"]:
                found = [(top[0]["a"], top[0]["b"], top[0]["cnt"])]
                break
            inside = {(r["a"], r["b"]) for r in top}
            kept = state.mapInArrow(_fragment_batches(inside), "cnt long, symbols string")
            rows = kept.groupBy("symbols").agg(F.sum("cnt").alias("cnt")).limit(most_fragments + 1).collect()
            if len(rows) <= most_fragments or len(top) == 1:
                fragments = [(_split(r["symbols"]), r["cnt"]) for r in rows]
                found = merge_fragments(fragments, floor, min_freq, left, known)
                break
            look = max(1, look // 4)
        if len(rows if floor != top[0]["cnt"] else ()) < most_fragments // 8:
            look = min(look * 4, MOST_PAIRS)
        step += 1
        places: dict[tuple[str, str], list[int]] = {}
        for place, (a, b, n) in enumerate(found):
            places.setdefault((a, b), []).append(place)
            yield step, a, b, n
            left -= merged(a, b) not in known
            known.add(merged(a, b))
        before, path = path, scratch_path(spark, "symbols")
        state.mapInArrow(_merge_batches(places), "cnt long, symbols string").write.parquet(path)
        state = spark.read.schema("cnt long, symbols string").parquet(path)
        if before:
            discard(spark, before)


def train_subwords(
    words: DataFrame,
    vocab_size: int = 12_000,
    min_freq: int = 3,
    alphabet_size: int = 6000,
    merges_beyond: int | None = None,
) -> DataFrame:
    """Learn a subword vocabulary from distinct word counts.

    The result is that of merging the most frequent pair one by one, ties by the order of
    its symbols; see :func:`learn_merges` for how many are found at once. Ends when the
    vocabulary is full or no pair is frequent enough. With ``merges_beyond`` given, it is
    full at so many pieces beyond specials and letters, whatever their number.
    Columns: ``token, id, step, cnt``.
    """
    alphabet = materialize(limit_alphabet(words, alphabet_size), "alphabet")
    cores = words.sparkSession.sparkContext.defaultParallelism
    spread = word_symbols(words, alphabet).repartition(max(cores, words.rdd.getNumPartitions()))
    state = materialize(spread.select(F.col("cnt").cast("long").alias("cnt"), "symbols"), "symbols")
    singles = state.select(
        F.explode(F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), EDGE + EDGE, -1)).alias("token")
    )
    start = [r["token"] for r in singles.distinct().orderBy("token").collect()]  # alphabet: bounded by its limit
    rows = [(t, i, 0, 0) for i, t in enumerate(PIECE_SPECIALS + start)]
    room = merges_beyond if merges_beyond is not None else vocab_size - len(rows)
    known = {r[0] for r in rows}
    listed = set(known)
    for step, a, b, cnt in learn_merges(state, known, room, min_freq):
        if merged(a, b) not in listed:
            listed.add(merged(a, b))
            rows.append((merged(a, b), len(rows), step, cnt))
    return words.sparkSession.createDataFrame(rows, "token string, id int, step int, cnt bigint")


def greedy_pieces(word: str, vocab: dict[str, int], unknown: int = 1, longest: int | None = None) -> list[int]:
    """Longest match from the left; a word that cannot be covered is unknown.

    ``longest`` is the most characters of a piece: with it, a word costs its length times
    that, and not its length squared.
    """
    out, start = [], 0
    while start < len(word):
        prefix = MARK if start else ""
        for end in range(min(len(word), start + (longest or len(word))), start, -1):
            piece = vocab.get(prefix + word[start:end])
            if piece is not None:
                out.append(piece)
                start = end
                break
        else:
            return [unknown]
    return out


def _piece_batches(vocab, room: int):
    """Arrow batches of keys and a token array (last) to keys and framed piece ids.

    A task codes each word once as long as it holds it; it holds at most HELD_WORDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocab.value
        longest = max([len(token) for token in table], default=1)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(held) > HELD_WORDS:
                held.clear()
            for word in words:
                if word not in held:
                    held[word] = np.array(greedy_pieces(word, table, longest=longest), np.int32)
            pieces = [held[word] for word in words]
            found = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32),
                np.concatenate([np.empty(0, np.int32), *pieces]),
            )
            # The tokens of a line that can reach into it: the first ``room``, as a word has a piece at least.
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, kept = np.cumsum(sizes) - sizes, np.minimum(sizes, room)
            place = np.arange(kept.sum()) + np.repeat(first - (np.cumsum(kept) - kept), kept)
            own = found.take(coded.indices.take(pa.array(place)))
            counts = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(kept)]
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            ids, cut = own.flatten().to_numpy(zero_copy_only=False), np.minimum(ends - starts, room)
            offsets = np.concatenate([[0], np.cumsum(cut + 2)])
            made = np.full(offsets[-1], CLS, np.int32)
            made[offsets[1:] - 1] = SEP
            row = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
            made[np.repeat(offsets[:-1] + 1, cut) + row] = ids[np.repeat(starts, cut) + row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets.astype(np.int32), made)],
                names=[str(i) for i in range(batch.num_columns)],
            )

    return run


def encode_subwords(
    line_tokens: DataFrame, vocab: DataFrame, keys: list[str], max_length: int = 256
) -> DataFrame:
    """Lines to ``CLS pieces SEP``, cut at ``max_length``, inside their rows.

    A subword vocabulary has a given maximal size, so it is sent to the tasks; nothing is shuffled.
    """
    table = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
    sent = line_tokens.sparkSession.sparkContext.broadcast(table)
    lines = line_tokens.select(*keys, F.filter("tokens", lambda t: t != "").alias("tokens"))  # nor nulls
    return lines.mapInArrow(_piece_batches(sent, max_length - 2), with_keys(line_tokens, keys, "ids array<int>"))
