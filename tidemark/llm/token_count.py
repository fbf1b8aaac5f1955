"""Token counts without token ids.

Method: texts are cut into pre-tokens at places no piece of the vocabulary
spans, pieces are counted once per distinct pre-token, and a document's count
is the sum over its pre-token frequencies. The most frequent pre-tokens (a
table of fixed size) reach the documents as a broadcast; the frequencies of all
others are joined by a shuffle, so neither the vocabulary nor a hot word has to
fit into one task.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted one by one; ids may be null or repeated; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SharedTable, materialize, most_frequent, per_process, pick, vocabulary

HEAD_WORDS = 1 << 18

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = r"!-/:-@\[-`{-~"
_FINE = re.compile(rf" *[{_LETTER}]+| *[{_SIGN}]+| *[0-9]|\n| +")
_COARSE = re.compile(r" +[^ \n]*|\n[^ \n]*|^[^ \n]+")
_OTHER = re.compile(rf"[^{_LETTER}{_SIGN}0-9 \n]")
_SPANS_FINE = re.compile(rf"[{_LETTER}][{_SIGN}]|[{_SIGN}][{_LETTER}]|[0-9][{_LETTER}{_SIGN}0-9▁]|[{_LETTER}{_SIGN}▁][0-9]"
                         rf"|[^▁]▁|\n.|.\n")
_SPANS_COARSE = re.compile(r"[^▁]▁|\n.|.\n")


def load_pieces(model_file: str):
    """The processor of a model file, kept once per process."""
    import sentencepiece

    return per_process("pieces", model_file, lambda: sentencepiece.SentencePieceProcessor(model_file=model_file))


def cuts_of(model_file: str) -> str:
    """'fine' where no piece spans a change between letters, signs and digits; 'coarse' where none spans a space."""
    processor = load_pieces(model_file)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())
              if not processor.is_byte(i) and not processor.is_control(i) and not processor.is_unknown(i)]
    if any(_SPANS_COARSE.search(p) for p in pieces):
        raise ValueError("pieces span spaces or line ends: this vocabulary has no pre-tokens")
    if processor.encode(" a  b ", out_type=str) != processor.encode("▁a▁▁b▁", out_type=str):
        raise ValueError("the model normalises spaces: pre-tokens would differ")
    return "coarse" if any(_SPANS_FINE.search(p) for p in pieces) else "fine"


def split_pretokens(text: str, cuts: str = "fine") -> list[str]:
    """Pre-tokens of a text in order; a space stands for the mark before a word."""
    marked = " " + text.replace("▁", " ")
    if cuts == "fine" and not _OTHER.search(marked):
        return _FINE.findall(marked)
    return _COARSE.findall(marked)


def count_pieces(words: list[str], model_file: str) -> list[int]:
    """Pieces of each pre-token as they are in a whole text.

    The library puts a mark before every text it gets. A pre-token that starts
    with spaces gives one of them up for it; any other one is put behind a line
    end, which no piece joins, and the two additional pieces are taken off.
    """
    processor = load_pieces(model_file)
    asked = [w[1:] if w[0] == " " else "\n" + w for w in words]
    found = processor.encode(asked, num_threads=1)
    return [1 if w == " " else len(ids) if w[0] == " " else len(ids) - 2 for w, ids in zip(words, found)]


def pretoken_pieces(words: DataFrame, model_file: str) -> DataFrame:
    """(word, n) to (word, n, pieces); each distinct pre-token is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_pieces(batch.column(0).to_pylist(), model_file) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], ["word", "n", "pieces"])

    return words.mapInArrow(run, "word string, n long, pieces int")


def _frequencies(head, split: Callable[[str], list[str]]):
    """Per document: bytes, pieces of its frequent pre-tokens, frequencies of the others."""

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()),
                        ("rest", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = head.made("pieces", lambda t: dict(zip(t["word"].to_pylist(), t["pieces"].to_pylist())))
        for batch in batches:
            n_bytes, known, rest = [], [], []
            for text in batch.column(2).to_pylist():
                total, others = 0, []
                if text:
                    for word, times in Counter(split(text)).items():
                        count = pieces.get(word)
                        if count is None:
                            others.append({"word": word, "times": times})
                        else:
                            total += count * times
                n_bytes.append(len(text.encode()) if text else 0)
                known.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(rest, schema.field("rest").type)], schema=schema)

    return run


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the sentencepiece library counts the whole text.

    `head_words` bounds the broadcast table of frequent pre-tokens; it never
    changes a result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = cuts_of(model_file)
    split = functools.partial(split_pretokens, cuts=cuts)
    words = materialize(pretoken_pieces(vocabulary(rows, split), model_file), "pretokens")
    head = SharedTable(most_frequent(words, head_words).select("word", "pieces"))

    per_doc = (rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
               .mapInArrow(_frequencies(head, split),
                           "row long, doc_id long, n_bytes long, known long, rest array<struct<word:string,times:long>>"))
    # One row per rare pre-token; the document's own figures ride on the first one.
    # Documents without any get a key of their own, which no pre-token equals.
    spread = per_doc.select("row", "doc_id", "n_bytes", "known", F.posexplode_outer("rest").alias("at", "one")).select(
        "row", F.when(F.coalesce("at", F.lit(0)) == 0, F.struct("doc_id", "n_bytes", "known")).alias("doc"),
        F.coalesce("one.word", F.concat(F.lit("\n\n"), F.col("row").cast("string"))).alias("word"),
        F.col("one.times").alias("times"))
    joined = spread.join(words.select("word", "pieces"), "word", "left")
    total = F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0))
    summed = joined.groupBy("row").agg(F.max("doc").alias("doc"), total.alias("others"))
    n_tokens = F.col("doc.known") + F.col("others")
    return summed.select("doc.doc_id", "doc.n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
