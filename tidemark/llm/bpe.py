"""Byte-pair encoding and decoding of whole texts by way of a distinct-word table.

Method: texts are split into words at places the tokenizer itself always
splits, every distinct word is encoded once, the ids are joined back by
position, and the decoded text comes from joining ids with their pieces. The
table has two parts. The most frequent words of a sample of documents, a bounded
number, reach the documents as a broadcast; a document then is a list of word
numbers with holes for all other words. Those meet by word in a shuffle, where
each is encoded, and their ids fill the holes by document and position. Sample
and bound decide what a run costs, never what it returns.

Defined results: a null or empty text has no tokens and decodes to the empty
text; repeated rows stay repeated; ids may be null or repeated; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, HOT_GROUPS, SharedTable, materialize, most_frequent, per_process, pick, vocabulary

HEAD_WORDS = 1 << 18
SAMPLE_DOCS = 20_000
REPEATS = 10_000
MAX_PIECES = 1 << 14
HOLE = 0

# Texts made only of these characters are cut just as the tokenizer's pattern
# cuts them; lower-casing is one to one here and nothing composes.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = r"!-/:-@\[-`{-~"
_WORDS = re.compile(rf"'(?:[sStTmMdD]|[rRvV][eE]|[lL][lL])|[{_LETTER}]+|[0-9]|[{_SIGN}]+")
_OTHER = re.compile(rf"[^{_LETTER}{_SIGN}0-9 \t\n\r]")
_CHUNKS = re.compile(r"[^ \t\n\r]+")



class WordTokenizer:
    """A tokenizer whose tokens never span white space, loaded from a tokenizer file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]

    @staticmethod
    def of(file: str) -> "WordTokenizer":
        return per_process("words", file, lambda: WordTokenizer(file))

    def split(self, text: str) -> list[str]:
        """Words in order. Special strings are words; other words are lower-cased where that is one to one."""
        if self.special is None or not self.special.search(text):
            return self._cut(text)
        words = []
        for i, part in enumerate(self.special.split(text)):
            words += [part] if i % 2 else self._cut(part)
        return words

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _OTHER.search(text):
            return _CHUNKS.findall(text)
        return _WORDS.findall(text.lower())

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def check_tokenizer(file: str) -> None:
    """Refuse files whose results can't be put together from words: another decoder or another splitting."""
    import json

    with open(file, encoding="utf-8") as f:
        parts = json.load(f)
    if parts.get("decoder") is not None or parts.get("post_processor") is not None:
        raise ValueError("only tokenizers that join pieces with a space are decoded from words")
    tokenizer = WordTokenizer.of(file)
    for text in ("It's we'll 'S don't 're \"'s (a1b22c) x,'ve", "Äß éÀ'd 's's''t -'M a'LLo", " \t\r\n a\nb  c "):
        if [i for ids in tokenizer.encode(tokenizer.split(text)) for i in ids] != tokenizer.encode([text])[0]:
            raise ValueError("this tokenizer cuts words in another way")


def id_kind(file: str) -> str:
    """Little-endian numbers wide enough for every id."""
    return "<u2" if len(WordTokenizer.of(file).pieces) <= 1 << 16 else "<u4"


def word_ids(words: DataFrame, file: str) -> DataFrame:
    """(word, n) to (word, n, ids): each distinct word is encoded once."""
    kind = id_kind(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(file)
        for batch in batches:
            found = tokenizer.encode(batch.column(0).to_pylist()) if batch.num_rows else []
            packed = pa.array([np.array(ids, kind).tobytes() for ids in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], ["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids binary")


def rare_word_ids(holes: DataFrame, file: str) -> DataFrame:
    """(doc_id, key, word, places) to (doc_id, key, places, ids): words meet in a shuffle and are encoded once where they meet.

    A partition that a hot word makes large is split, so such a word may be
    encoded in several tasks, but its rows never gather in one.
    """
    kind = id_kind(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = WordTokenizer.of(file), {}
        for batch in batches:
            words = batch.column(2).to_pylist()
            new = [w for w in dict.fromkeys(words) if w not in known]
            last = {words[0]: known[words[0]]} if words and words[0] in known else {}
            known = last | {w: np.array(ids, kind).tobytes() for w, ids in zip(new, tokenizer.encode(new))}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(map(known.__getitem__, words), pa.binary())],
                ["doc_id", "key", "places", "ids"])

    return (holes.hint("rebalance", "word").sortWithinPartitions("word")
            .mapInArrow(run, "doc_id long, key long, places array<int>, ids binary"))


# Word numbers are stored by frequency in 1, 2, 3 or 5 bytes, apart by length; 0 is a hole.
_ONE, _TWO = 192, 62 * 256
_THREE = _ONE + _TWO
_FIVE = _THREE + (1 << 16)


def _pack(numbers: np.ndarray, ends: list[int]) -> list[bytes]:
    """Word numbers of texts laid end to end, packed text by text."""
    two = (numbers >= _ONE) & (numbers < _THREE)
    three = (numbers >= _THREE) & (numbers < _FIVE)
    five = numbers >= _FIVE
    lead = np.where(two, _ONE + ((numbers - _ONE) >> 8), numbers)
    lead[three], lead[five] = 254, 255
    parts = [lead.astype(np.uint8), (numbers[two] - _ONE).astype(np.uint8), (numbers[three] - _THREE).astype("<u2"),
             numbers[five].astype("<u4")]
    at = np.array([0, *ends])
    cuts = [at, *(np.concatenate([[0], np.cumsum(mask)])[at] for mask in (two, three, five))]
    heads = np.stack([np.diff(c) for c in cuts], axis=1).astype("<u4")
    cuts = [c.tolist() for c in cuts]
    press = zstandard.ZstdCompressor(level=3).compress
    return [press(heads[i].tobytes() + b"".join(p[c[i]:c[i + 1]].tobytes() for p, c in zip(parts, cuts))) for i in range(len(ends))]


def _unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts laid end to end, and how many each text has."""
    open_one = zstandard.ZstdDecompressor().decompress
    sizes, pieces = [], [[], [], [], []]
    for plain in map(open_one, packed):
        counts = np.frombuffer(plain, "<u4", 4).tolist()
        at = 16
        for kept, n, width in zip(pieces, counts, (1, 1, 2, 4)):
            kept.append(plain[at:at + n * width])
            at += n * width
        sizes.append(counts[0])
    lead, twos, threes, fives = (np.frombuffer(b"".join(p), k).astype(np.int64) for p, k in zip(pieces, (np.uint8, np.uint8, "<u2", "<u4")))
    two, three, five = (lead >= _ONE) & (lead < 254), lead == 254, lead == 255
    out = lead.copy()
    out[two] = _ONE + ((lead[two] - _ONE) << 8) + twos
    out[three] = _THREE + threes
    out[five] = fives
    return out, np.array(sizes, np.int64)


class _Numbers(dict):
    """Word to number; every other word is a hole."""

    def __missing__(self, word):
        return HOLE


def _numbers(table: pa.Table) -> _Numbers:
    return _Numbers(zip(table["word"].to_pylist(), range(1, table.num_rows + 1)))


def _texts(table: pa.Table, pieces: list[str], kind: str) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids and pieces of the frequent words as text, and their numbers of tokens; number 0 is the hole."""
    found = [[], *(np.frombuffer(ids, kind).tolist() for ids in table["ids"].to_pylist())]
    return (pa.array([" ".join(map(str, ids)) for ids in found], pa.string()),
            pa.array([" ".join(map(pieces.__getitem__, ids)) for ids in found], pa.string()), np.array(list(map(len, found)), np.int64))


def _numbered(head: SharedTable, file: str):
    """(doc_id, key, text) to word numbers with holes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = WordTokenizer.of(file).split, head.made("numbers", _numbers).__getitem__
        for batch in batches:
            found, ends = [], []
            for text in batch.column(2).to_pylist():
                if text:
                    words = split(text)
                    found.append(np.fromiter(map(number, words), np.int64, len(words)))
                ends.append((ends[-1] if ends else 0) + (len(found[-1]) if text else 0))
            packed = _pack(np.concatenate(found) if found else np.empty(0, np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             ["doc_id", "key", "numbers"])

    return run


def _holes(head: SharedTable, file: str):
    """(doc_id, key, text) to one row per rare word of a document, with the holes it fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = WordTokenizer.of(file).split, head.made("numbers", _numbers)
        for batch in batches:
            ids, keys, words, places = [], [], [], []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[str, list[int]] = {}
                for at, word in enumerate(itertools.filterfalse(number.__contains__, split(text) if text else ())):
                    found.setdefault(word, []).append(at)
                ids += [doc_id] * len(found)
                keys += [key] * len(found)
                words += found.keys()
                places += found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.string()),
                 pa.array(places, pa.list_(pa.int32()))], ["doc_id", "key", "word", "places"])

    return run


def _filled(head: SharedTable, file: str, with_text: bool):
    """Rows of a document in order, fillings first, to its ids and decoded text."""
    kind = id_kind(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordTokenizer.of(file).pieces
        all_ids, all_text, all_sizes = head.made("texts", lambda t: _texts(t, pieces, kind))

        def joined(numbers: list[bytes], fillings: list[list]) -> tuple[list, ...]:
            """Token counts, ids and decoded texts of some documents."""
            codes, lengths = _unpack(numbers)
            extra = [one for some in fillings for one in some]
            holes = codes == HOLE
            codes[holes] = len(all_ids) + np.arange(len(extra))
            tokens = np.concatenate([all_sizes, np.array([len(x) for x in extra], np.int64)])[codes]
            ends = np.cumsum(lengths)
            totals = np.diff(np.concatenate([[0], np.cumsum(tokens)])[np.concatenate([[0], ends])])
            some = tokens > 0  # a word of nothing but dropped characters has no token and no place in the text
            offsets = pa.array(np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], ends])], pa.int32())
            wanted = pa.array(codes[some])

            def text(known, more):
                words = pa.concat_arrays([known, pa.array(more, pa.string())]).take(wanted)
                return pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")

            out = (text(all_ids, (" ".join(map(str, x)) for x in extra)),
                   text(all_text, (" ".join(map(pieces.__getitem__, x)) for x in extra)))
            if not with_text:
                out = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in out]
            return pa.array(totals), *out

        current, fill, waiting = None, {}, ([], [], [], [])

        def flush():
            docs, keys, numbers, fillings = waiting
            done = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), *joined(numbers, fillings)],
                                              ["doc_id", "key", "n_tokens", "ids", "decoded"])
            for kept in waiting:
                kept.clear()
            return done

        size = 0
        for batch in batches:
            for doc_id, key, numbers, places, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc_id, key) != current:
                    current, fill = (doc_id, key), {}
                if places is None:
                    for kept, value in zip(waiting, (doc_id, key, numbers, [fill[i] for i in range(len(fill))])):
                        kept.append(value)
                    size += len(numbers)
                    if size >= BATCH_BYTES // 8:
                        yield flush()
                        size = 0
                else:
                    found = np.frombuffer(ids, kind).tolist()
                    for at in places:
                        fill[at] = found
        if waiting[0]:
            yield flush()

    return run


def _encoded(docs: DataFrame, file: str, id_col: str, text_col: str, head_words: int, sample_docs: int, with_text: bool,
             repeats: int) -> DataFrame:
    check_tokenizer(file)
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    total = rows.count()
    share = sample_docs / max(1, total)
    sample = rows.where(F.rand(42) < share) if share < 1 else rows
    words = materialize(vocabulary(sample, lambda text: WordTokenizer.of(file).split(text)), "words")
    head = SharedTable(word_ids(most_frequent(words, head_words), file), [("n", "descending"), ("word", "ascending")])

    def encode(some: DataFrame) -> DataFrame:
        # Both branches name a document by its id and text hash: rows equal in
        # both have equal results, so repeated rows may share their fillings.
        numbered = some.mapInArrow(_numbered(head, file), "doc_id long, key long, numbers binary")
        holes = some.mapInArrow(_holes(head, file), "doc_id long, key long, word string, places array<int>")
        fillings = rare_word_ids(holes, file).select("doc_id", "key", F.lit(None).cast("binary").alias("numbers"), "places", "ids")
        both = fillings.unionByName(numbered.select(
            "doc_id", "key", "numbers", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("binary").alias("ids")))
        return (both.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", F.col("places").isNull())
                .mapInArrow(_filled(head, file, with_text), "doc_id long, key long, n_tokens long, ids string, decoded string"))

    # Rows equal in id and text meet in one task. Those repeated more often than
    # a task's share are encoded once and their results repeated by pieces;
    # there are fewer than HOT_GROUPS such groups.
    often = max(repeats, total // HOT_GROUPS)
    hot = materialize(rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often)
                      .withColumnsRenamed({"doc_id": "hot_id", "key": "hot_key"}), "repeated")
    pieces = hot.agg(F.sum(F.ceil(F.col("n") / repeats))).first()[0]
    if not pieces:
        return encode(rows).drop("key")
    hot, same = F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("key") == F.col("hot_key"))
    once = encode(rows.join(hot, same, "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text")))
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / repeats) - 1))
    share = F.least(F.lit(repeats), F.col("n") - F.col("piece") * repeats).cast("int")
    repeated = (once.join(hot, same).select(*once.columns, "n", piece.alias("piece")).repartition(min(pieces, MAX_PIECES), "doc_id", "key", "piece")
                .withColumn("copy", F.explode(F.array_repeat(F.lit(0), share))).select(*once.columns))
    return encode(rows.join(hot, same, "left_anti")).unionByName(repeated).drop("key")


def bpe_round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text",
                   head_words: int = HEAD_WORDS, sample_docs: int = SAMPLE_DOCS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decimal ids joined by a space, and the text they decode to.

    Ids are those of the tokenizers library without added special tokens;
    special strings inside a text become their own ids, as is its default.
    """
    return _encoded(docs, file, id_col, text_col, head_words, sample_docs, True, repeats)


def bpe_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text",
                head_words: int = HEAD_WORDS, sample_docs: int = SAMPLE_DOCS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip with both strings as sha256 in hex."""
    return (_encoded(docs, file, id_col, text_col, head_words, sample_docs, False, repeats)
            .withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}))
