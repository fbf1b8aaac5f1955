"""Language-model scores from a log-frequency Bloom filter.

Method: counts of words and word pairs are quantised to powers of a base; an
n-gram of level q is put into a Bloom filter q times, as (n-gram, 1) to
(n-gram, q). A count is read back by probing levels until one is missing.
Filters are built by segments on the executors and broadcast; a pair's
probability is its count smoothed towards its word's share:

    P(w | h) = (count(h w) + mass * share(w)) / (count(h) + mass)
    share(w) = (count(w) + 0.1) / (N + 0.1 * (V + 1))

A broadcast holds at most `max_filter_bytes` of pair segments; where there are
more, texts are read once for each broadcast, and each pair is scored in the
pass that has its segment. The filter of single words has as many bits an
entry at any size. Where it exceeds one broadcast of the same bound, texts are
first read once for each part of it, and the level of every token, a byte, is
joined to its text.

The base score takes exact counts: those of the most frequent words (a table
of fixed size) by broadcast, all others by a join.

Tokens are the words between white space, A-Z lower-cased, then one end.
Defined results: a null or empty text is one end token; without training texts
every count is 0; repeated rows are scored one by one; ids may be null (then
crc32 of the empty text decides); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SharedTable, materialize, most_frequent, per_process, pick, vocabulary

END = b"\xff"  # a byte that no text in UTF-8 has
HEAD_WORDS = 1 << 18
MASS = 2000.0
HASHES = 4
BITS_PER_ENTRY = 7.0
MAX_FILTER_BYTES = 96 << 20
SEGMENT_GRAMS = 1 << 20
FLUSH_GRAMS = 1 << 21
LEVELS = 255
_BLOCK = 1 << 15
_LOW = np.uint64(0xFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words and the end."""
    return (text or "").encode().lower().split() + [END]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _start_hash() -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"\n"))


class _Index(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class WordTable:
    """Numbers of words, with their hashes and whatever `describe` says of them; forgotten beyond a bound."""

    def __init__(self, describe=None, bound: int = 300_000):
        self.describe, self.bound = describe, bound
        self._reset()

    def _reset(self):
        self.index = _Index()
        self.hashes, self.facts = np.empty(0, np.uint64), None

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.bound:
            self._reset()
        known = len(self.index)
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(self.index, known, None))
        if new:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, hashes])
            if self.describe:
                facts = self.describe(new, hashes)
                self.facts = facts if self.facts is None else np.concatenate([self.facts, facts], axis=1)
        return found

    def laid_out(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Tokens of texts laid end to end, their numbers, and where each text begins."""
        line = b"".join(b"%b %b " % ((text or "").encode(), END) for text in texts).lower().split()
        numbers = self.numbers(line)
        ends = np.flatnonzero(numbers == self.index[END]) if line else np.empty(0, np.int64)
        return line, numbers, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends


def shifted(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value of the token before; `first` at the beginning of a text."""
    before = np.empty_like(values)
    if len(values):
        before[1:] = values[:-1]
        before[starts] = first
    return before


def pair_grams(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _mix(shifted(own, starts, _start_hash()) * _GOLDEN + own)


def word_grams(own: np.ndarray) -> np.ndarray:
    return _mix(own + _GOLDEN)


def quantise(counts: np.ndarray, base: float) -> np.ndarray:
    """1 for a count of 1, one more for each power of the base reached."""
    return (np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9) + 1).astype(np.int64)


def level_counts(base: float, levels: int = LEVELS) -> np.ndarray:
    """The count that stands for each level: the middle of its range; 0 for level 0."""
    edges = np.ceil(base ** np.arange(levels + 1, dtype=float) - 1e-9)
    return np.concatenate([[0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2])


def _doubled(rest: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (n-gram, level) from which its places follow."""
    x = _mix(rest + np.uint64(level * int(_GOLDEN) % (1 << 64)))
    return x >> np.uint64(32), (x & _LOW) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, i: int, sizes) -> np.ndarray:
    """The i-th bit place in segments of `sizes` bits."""
    return (((first + np.uint64(i) * step) & _LOW) * sizes) >> np.uint64(32)


def _segment(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)


def _rest(grams: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits that follow those of the segment: what a segment knows an n-gram by."""
    return (grams << np.uint64(bits)) >> np.uint64(24)


@dataclass
class LogBloom:
    """Segments `first` and on of a log-frequency Bloom filter of 2^bits segments."""

    bits: int
    first: int
    sizes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    base: float

    def holds(self, grams: np.ndarray) -> np.ndarray:
        """Whether an n-gram's segment is here."""
        at = _segment(grams, self.bits) - self.first
        return (at >= 0) & (at < len(self.sizes))

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Counts of n-grams whose segments are here, read back by probing level after level."""
        return level_counts(self.base)[self.levels(grams)]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        reached = np.zeros(len(grams), np.int64)
        for at in range(0, len(grams), _BLOCK):  # blocks that stay in the processor's cache
            self._probe(grams[at:at + _BLOCK], reached[at:at + _BLOCK])
        return reached

    def _probe(self, grams: np.ndarray, reached: np.ndarray) -> None:
        at = _segment(grams, self.bits) - self.first
        sizes, offsets, rest = self.sizes[at], self.offsets[at], _rest(grams, self.bits)
        alive, level = np.flatnonzero(sizes > 0), 0
        while len(alive) and level < LEVELS:
            level += 1
            first, step = _doubled(rest[alive], level)
            for i in range(HASHES):
                place = _place(first, step, i, sizes[alive])
                octet = self.data[offsets[alive] + (place >> np.uint64(3)).astype(np.int64)]
                hit = ((octet >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                alive, first, step = alive[hit], first[hit], step[hit]
            reached[alive] = level


_PACKED = "segment int, grams binary, counts binary"


def _pack_counts(grams: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per segment of ascending n-grams: their differences and their counts, by byte planes."""
    cuts = np.flatnonzero(np.diff(_segment(grams, bits))) + 1
    press = zstandard.ZstdCompressor(level=3).compress
    rows = [[], [], []]
    for some, seen in zip(np.split(grams, cuts), np.split(counts, cuts)):
        steps = np.diff(_rest(some, bits), prepend=np.uint64(0))
        rows[0].append(int(_segment(some[:1], bits)[0]))
        rows[1].append(press(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()))
        rows[2].append(press(seen.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()),
                                       pa.array(rows[2], pa.binary())], ["segment", "grams", "counts"])


def _planes(packed: bytes, width: int, kind: str) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pair_counts(bits: int):
    """Training texts to packed pair counts; a task holds FLUSH_GRAMS pairs at most before it adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = WordTable(), [], 0

        def out():
            return _pack_counts(*np.unique(np.concatenate(held), return_counts=True), bits)

        for batch in batches:
            _, numbers, starts = table.laid_out(batch.column(0).to_pylist())
            held.append(pair_grams(table.hashes[numbers], starts))
            n += len(held[-1])
            if n >= FLUSH_GRAMS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def _word_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = word_grams(np.fromiter(map(xxhash.xxh64_intdigest, batch.column(0).to_pylist()), np.uint64, batch.num_rows))
                order = np.argsort(grams)
                yield _pack_counts(grams[order], batch.column(1).to_numpy()[order], bits)

    return run


def build_segments(packed: DataFrame, base: float, bits_per_entry: float) -> DataFrame:
    """(segment, bits, data): the Bloom filter of each segment, sized by its entries.

    A segment's n-grams come already added up by task, and n-grams are spread
    over segments by hash, so a group is of even and bounded size.
    """

    def build(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        every = np.concatenate([np.cumsum(_planes(g, 8, "<u8")) for g in rows["grams"]])
        counts = np.concatenate([_planes(c, 8, "<u8") for c in rows["counts"]]).astype(np.int64)
        order = np.argsort(every)
        every, counts = every[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        rest, levels = every[starts], quantise(np.add.reduceat(counts, starts), base)
        size = max(64, math.ceil(int(levels.sum()) * bits_per_entry))
        data = np.zeros(-(-size // 8) * 8, np.uint8)  # one byte per bit while it is built
        for level in range(1, int(levels.max()) + 1):
            first, step = _doubled(rest[levels >= level], level)
            for i in range(HASHES):
                data[_place(first, step, i, np.uint64(size)).astype(np.int64)] = 1
        return pa.table({"segment": pa.array([rows["segment"][0]], pa.int32()), "bits": pa.array([size], pa.int64()),
                         "data": pa.array([np.packbits(data, bitorder="little").tobytes()], pa.binary())})

    return packed.groupBy("segment").applyInArrow(build, "segment int, bits long, data binary")


class SharedFilter:
    """A run of segments sent to all executors as plain bytes, which their Python workers map instead of holding a copy each."""

    def __init__(self, segments: DataFrame, first: int, last: int, bits: int, base: float):
        some = segments.where(F.col("segment").between(first, last))
        sizes, offsets = np.zeros(last - first + 1, "<u8"), np.zeros(last - first + 1, "<i8")
        octets = some.agg(F.sum(F.length("data"))).first()[0] or 0
        head = len(sizes) * 16
        data, at = bytearray(head + max(1, octets)), 0  # bounded by the caller
        for row in some.toLocalIterator():
            sizes[row.segment - first], offsets[row.segment - first] = row.bits, at
            data[head + at:head + at + len(row.data)] = row.data
            at += len(row.data)
        data[:head] = sizes.tobytes() + offsets.tobytes()
        self.first, self.bits, self.base, self.length, self.key = first, bits, base, len(sizes), uuid.uuid4().hex
        self.sent = segments.sparkSession.sparkContext.broadcast(bytes(data))

    def made(self, kind: str) -> LogBloom:
        """The filter; the last one of its kind is kept by a process."""

        def make():
            data, n = mapped_bytes(self.sent), self.length
            return LogBloom(self.bits, self.first, data[:8 * n].view("<u8"), data[8 * n:16 * n].view("<i8"), data[16 * n:], self.base)

        return per_process(kind, self.key, make)


def mapped_bytes(sent) -> np.ndarray:
    """Bytes of a broadcast, mapped from the file that Spark keeps for the Python workers of an executor.

    That file is a pickle of one bytes object: two bytes of protocol, the
    opcode, the length and the bytes. If there is no such file, as on the driver
    or with encryption, the value is read the usual way.
    """
    path = getattr(sent, "_path", None)
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as file:
            head = file.read(16)
        width = {0x42: 4, 0x8E: 8}[head[2]]  # fixed values: opcodes of bytes with a length of 4 and of 8 bytes
        length = int.from_bytes(head[3:3 + width], "little")
        if head[0] == 0x80 and 3 + width + length < size <= 3 + width + length + 16:
            return np.memmap(path, np.uint8, "r", 3 + width, (length,))
    except (TypeError, OSError, KeyError, IndexError):
        pass
    return np.frombuffer(sent.value, np.uint8)


class FrequentWords:
    """Counts of the most frequent words, found by their sorted hashes and verified by their bytes."""

    def __init__(self, table: pa.Table):
        words = table["word"].combine_chunks()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], words.take(pa.array(order))
        self.counts = table["n"].to_numpy()[order]

    def look_up(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Count of each word, 0 for those that are not frequent."""
        out = np.zeros(len(words))
        at = np.searchsorted(self.hashes, hashes)
        near = np.append(self.hashes, np.uint64(0))[at] == hashes
        for i in np.flatnonzero(near & (at < len(self.hashes))).tolist():
            place = int(at[i])
            while place < len(self.hashes) and self.hashes[place] == hashes[i]:
                if self.words[place].as_py() == words[i]:
                    out[i] = self.counts[place]
                place += 1
        return out


def _runs_of_segments(segments: DataFrame, count: int, max_bytes: int) -> list[tuple[int, int]]:
    """Runs of neighbouring segments with at most `max_bytes` together."""
    sizes = segments.select("segment", F.length("data").alias("size")).toArrow().sort_by("segment")
    runs, first, total = [], 0, 0
    for segment, size in zip(sizes["segment"].to_pylist(), sizes["size"].to_pylist()):
        if total + size > max_bytes and segment > first:
            runs.append((first, segment - 1))
            first, total = segment, 0
        total += size
    return [*runs, (first, count - 1)]


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", base: float = 2.0,
                mass: float = MASS, bits_per_entry: float = BITS_PER_ENTRY, max_filter_bytes: int = MAX_FILTER_BYTES,
                head_words: int = HEAD_WORDS, segment_grams: int = SEGMENT_GRAMS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that `train`, a condition on doc_id, admits.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = rows.sparkSession
    training = rows.where(train).select("text")

    words = materialize(vocabulary(training, tokens, "binary"), "words")
    seen = words.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = seen.total or 0, seen.distinct
    ends = words.where(F.col("word") == F.lit(END)).first()
    texts = ends.n if ends else 0
    head = SharedTable(most_frequent(words, head_words))

    def segment_bits(grams: int) -> int:
        return min(30, max(0, math.ceil(math.log2(max(1, grams) / segment_grams))))

    word_bits, pair_bits = segment_bits(distinct), segment_bits(total)
    word_segments = materialize(build_segments(words.mapInArrow(_word_counts(word_bits), _PACKED), base, bits_per_entry), "word_filter")
    word_runs = _runs_of_segments(word_segments, 1 << word_bits, max_filter_bytes)
    pair_segments = materialize(build_segments(training.mapInArrow(_pair_counts(pair_bits), _PACKED), base, bits_per_entry), "pair_filter")
    runs = _runs_of_segments(pair_segments, 1 << pair_bits, max_filter_bytes)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(runs) > 1 or len(word_runs) > 1:  # several passes must see the same row numbers
        numbered = materialize(numbered, "rows")
    if len(word_runs) == 1:
        word_filter = SharedFilter(word_segments, *word_runs[0], word_bits, base)
    else:
        word_filter, numbered = None, _with_word_levels(numbered, word_segments, word_runs, word_bits, base)
    rest = "array<struct<word:binary,times:long>>"
    parts = []
    for number, (first, last) in enumerate(runs):
        pair_filter = SharedFilter(pair_segments, first, last, pair_bits, base)
        parts.append(numbered.mapInArrow(
            _scored(pair_filter, word_filter, head if number == 0 else None, total, distinct, texts, mass, base),
            f"row long, doc_id long, n_tokens long, known long, base double, score double, rest {rest}"))
    # One row per rare word; the document's own figures ride on the first one.
    # Documents without any get a key of their own, which no word equals.
    spread = parts[0].select("row", "doc_id", "n_tokens", "known", "base", "score", F.posexplode_outer("rest").alias("at", "one")).select(
        "row", F.when(F.coalesce("at", F.lit(0)) == 0, F.struct("doc_id", "n_tokens", "known", "base", "score")).alias("doc"),
        F.coalesce("one.word", F.concat(F.lit("\n\n"), F.col("row").cast("string")).cast("binary")).alias("word"),
        F.coalesce("one.times", F.lit(0)).alias("times"))
    count = F.coalesce("n", F.lit(0))
    summed = (spread.join(words, "word", "left").groupBy("row").agg(
        F.max("doc").alias("doc"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))).alias("base")))
    if len(parts) > 1:
        others = parts[1].select("row", "score")
        for part in parts[2:]:
            others = others.unionByName(part.select("row", "score"))
        others = others.groupBy("row").agg(F.sum("score").alias("other"))
        summed = summed.join(others, "row")
    else:
        summed = summed.withColumn("other", F.lit(0.0))
    return summed.select(
        "doc.doc_id", "doc.n_tokens", (F.col("doc.known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("doc.base") + F.col("base")).alias("base_score"),
        (F.col("doc.score") + F.col("other")).alias("score"))


def _word_levels(word_filter):
    """Rows to the levels of their tokens, a byte each; 0 for words whose segment is in another part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_filter.made("words")

        def describe(new, hashes):
            grams = word_grams(hashes)
            levels, here = np.zeros((1, len(grams)), np.uint8), np.flatnonzero(words.holds(grams))
            levels[0, here] = words.levels(grams[here])
            return levels

        table = WordTable(describe)
        for batch in batches:
            if batch.num_rows:
                line, numbers, starts = table.laid_out(batch.column(1).to_pylist())
                parts = np.split(table.facts[0][numbers], starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([part.tobytes() for part in parts], pa.binary())], ["row", "levels"])

    return run


def _with_word_levels(numbered: DataFrame, segments: DataFrame, runs: list[tuple[int, int]], bits: int, base: float) -> DataFrame:
    """Rows with `levels`, one array of bytes for each part of the filter of single words."""
    spark, every = numbered.sparkSession, None
    for first, last in runs:
        word_filter = SharedFilter(segments, first, last, bits, base)
        part = materialize(numbered.select("row", "text").mapInArrow(_word_levels(word_filter), "row long, levels binary"), "word_levels")
        word_filter.sent.unpersist()
        every = part if every is None else every.unionByName(part)
    levels = every.groupBy("row").agg(F.collect_list("levels").alias("levels"))
    return materialize(numbered.join(levels, "row").select("row", "doc_id", "text", "levels"), "levelled")


def _scored(pair_filter, word_filter, head, total: int, distinct: int, texts: int, mass: float, base_of_levels: float):
    """Rows to their model scores; with `head`, also to base scores of frequent words and the other words' frequencies.

    Without `word_filter`, rows carry the levels of their tokens.
    """
    kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    names = ["row", "doc_id", "n_tokens", "known", "base", "score", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = total + 0.1 * (distinct + 1)
        frequent = head.made("counts", FrequentWords) if head is not None else None
        pairs, words = pair_filter.made("pairs"), word_filter.made("words") if word_filter is not None else None

        def describe(new, hashes):
            """Count in the filter, exact base score (0 for rare words), whether the word is frequent."""
            exact = frequent.look_up(new, hashes) if frequent is not None else np.zeros(len(new))
            counts = words.counts(word_grams(hashes)) if words is not None else np.zeros(len(new))
            return np.stack([counts, np.where(exact > 0, np.log10((exact + 0.1) / scale), 0.0), exact > 0])

        table = WordTable(describe)
        for batch in batches:
            if not batch.num_rows:
                continue
            line, numbers, starts = table.laid_out(batch.column(2).to_pylist())
            own, (counts, base, known) = table.hashes[numbers], table.facts
            grams, single = pair_grams(own, starts), counts[numbers]
            if words is None:  # a word's level is in one part, the others have 0
                single = level_counts(base_of_levels)[np.concatenate([
                    np.bitwise_or.reduce([np.frombuffer(part, np.uint8) for part in parts]) for parts in batch.column(3).to_pylist()])]
            scores = np.zeros(len(line))
            here = np.flatnonzero(pairs.holds(grams))
            before = shifted(single, starts, texts)[here]
            together = np.minimum(pairs.counts(grams[here]), before)
            scores[here] = np.log10((together + mass * (single[here] + 0.1) / scale) / (before + mass))

            rare = np.flatnonzero(known[numbers] == 0) if head is not None else np.empty(0, np.int64)
            seen = Counter(zip((np.searchsorted(starts, rare, side="right") - 1).tolist(), map(line.__getitem__, rare.tolist())))
            texts_of = np.fromiter((at for at, _ in seen), np.int64, len(seen))  # ascending, as the tokens are
            words_of = pa.StructArray.from_arrays([pa.array((word for _, word in seen), pa.binary(), size=len(seen)),
                                                   pa.array(seen.values(), pa.int64())], ["word", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts_of, np.arange(len(starts) + 1)), pa.int32()), words_of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts, append=len(line))),
                 pa.array(np.add.reduceat(known[numbers], starts).astype(np.int64)), pa.array(np.add.reduceat(base[numbers], starts)),
                 pa.array(np.add.reduceat(scores, starts)), rest.cast(kind)], names)

    return run
