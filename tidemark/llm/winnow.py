"""Document fingerprints by winnowing.

Method: a rolling hash of every k-gram of code points; in every window of `w`
successive hashes the smallest one is chosen, the rightmost of equal ones; a
fingerprint is the list of chosen hashes with their positions. Two texts that
share a passage of w + k - 1 code points share a chosen hash, and no k-gram
outside that guarantee weighs more than its window. With the defaults that is 15 code
points, so a text of 29 or more shares a hash with its edited text below.

Defined results: a null or empty text has the empty fingerprint; a text
shorter than k has one hash, of the whole text, at position 0; one with fewer
than w k-grams has one window; equal texts have equal fingerprints; two empty
fingerprints are alike (1), an empty and another one are not (0).

Successors: documents go in ascending order of id, null first, equal ids by
text hash; documents equal in both follow each other in any order. Repeated
rows stay repeated; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, pick

K = 8
W = 8
CHUNK_CHARS = 4 << 20
MAX_CHUNKS = 1 << 16
_BASE = 0x9E3779B1
_BLOCK = 1 << 20
_HEX = np.array([f"{i:02x}".encode() for i in range(1 << 8)]).view("<u2")
_DIGITS = np.array([f"{i:04d}".encode() for i in range(10_000)]).view("<u4")


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k-gram mod 2^64, by doubling, mixed down to 32 bits."""
    have, power, total, width = points.astype(np.uint64) + np.uint64(1), np.uint64(_BASE), None, 0
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if total is None:
                    total, width = have, size
                else:
                    # the wider part comes first: have covers the next `size` points
                    n = len(points) - (width + size) + 1
                    total = total[:n] * power + have[width:width + n]
                    width += size
            if size * 2 > k:
                break
            n = len(points) - 2 * size + 1
            have = have[:n] * power + have[size:size + n]
            power = power * power
            size *= 2
        x = total
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(32)).astype(np.uint64)


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = w - size
    return np.minimum(keys[:len(keys) - rest], keys[rest:]) if rest else keys


def _without_runs(positions: np.ndarray) -> np.ndarray:
    """Distinct positions; successive windows choose the same one or a later one."""
    return positions[np.concatenate([[True], positions[1:] != positions[:-1]])]


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen for a text, by ascending position."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    none = np.empty(0, np.uint64)
    if len(points) == 0:
        return none, none
    k = min(k, len(points))
    grams = len(points) - k + 1
    w = min(w, grams)
    chosen, first = [], 0
    # Long texts go by blocks that overlap by what one window needs.
    while first + w <= grams:
        part = points[first:first + _BLOCK + w + k - 2]
        hashes = _gram_hashes(part, k)
        at = np.arange(len(hashes), dtype=np.uint64)
        # Smallest hash first, then the largest position: the rightmost of equal ones.
        minima = _window_minima((hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at), w)
        found = _without_runs(np.uint64(0xFFFFFFFF) - (minima & np.uint64(0xFFFFFFFF)))
        chosen.append(np.stack([hashes[found.astype(np.int64)], found + np.uint64(first)]))
        first += len(minima)
    if len(chosen) == 1:
        return chosen[0][0], chosen[0][1]
    both = np.concatenate(chosen, axis=1)
    new = np.concatenate([[True], both[1][1:] != both[1][:-1]])
    return both[0][new], both[1][new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two fingerprints' distinct hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """`hash@position` in order, joined by a space; written by runs of positions with as many digits."""
    out, at, digits = [], 0, 1
    while at < len(positions):
        end = int(np.searchsorted(positions, np.uint64(10 ** digits)))
        if end > at:
            line = np.empty((end - at, digits + 10), np.uint8)
            line[:, :8] = _HEX[hashes[at:end].astype(">u4").view(np.uint8)].view(np.uint8).reshape(-1, 8)
            line[:, 8], line[:, -1] = ord("@"), ord(" ")
            rest, right = positions[at:end], digits
            while right > 0:
                width = min(4, right)
                line[:, 9 + right - width:9 + right] = _DIGITS[rest % np.uint64(10_000)].view(np.uint8).reshape(-1, 4)[:, 4 - width:]
                rest, right = rest // np.uint64(10_000), right - width
            out.append(line.tobytes())
        at, digits = end, digits + 1
    return b"".join(out)[:-1].decode("ascii")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                          w: int = W) -> DataFrame:
    """(doc_id, fingerprint): chosen hashes with positions, `hash@position` in order, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_as_text(*winnow(t, k, w)) for t in batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "fingerprint"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _compared(k: int, w: int):
    """Rows of a chunk by order, the next chunk's first one last, to the result of each row but guests."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(doc_id, text, mark, after, after_mark):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        changed = winnow(edited, k, w) if edited != text else mark
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _as_text(*mark), _as_text(*changed),
                likeness(mark[0], changed[0]), likeness(mark[0], after_mark[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for chunk, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                mark = winnow(text, k, w)
                if held and held[0] == chunk:
                    out.append(result(held[1], held[2], held[3], text, mark))
                held = None if guest else (chunk, doc_id, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out
                                             else [pa.array([], t) for t in kinds], names)

    return run


def _chunked(rows: DataFrame, chunk_chars: int) -> DataFrame:
    """Rows (doc_id, text, mark) with their chunk, ascending by id, null first, then mark.

    Ids are cut at quantiles. An id that fills several parts, as null may, is
    cut by its marks as well, which are hashes and so lie evenly; only rows
    equal in id and text always share a chunk.
    """
    seen = rows.agg(F.sum(F.char_length("text")).alias("chars"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    parts = max(1, min(MAX_CHUNKS, -(-(seen.chars or 0) // chunk_chars), seen.n))
    missing_parts = max(1, parts * (seen.n - seen.ids) // max(1, seen.n))
    parts = min(parts, seen.ids)
    cuts: dict[int, int] = {}  # ids, and how many chunks their own rows take
    if parts > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        cuts = dict.fromkeys(found, 1)
        # Quantiles are doubles. Ids beside a repeated one are counted; fewer than `parts` hold more than a part.
        repeated = [float(v) for v, times in Counter(found).items() if times > 1]
        if repeated:
            busy = rows.where(F.col("doc_id").cast("double").isin(repeated)).groupBy("doc_id").count().where(F.col("count") > seen.ids / parts)
            cuts |= {r["doc_id"]: r["count"] * parts // seen.ids for r in busy.collect()}
    if not cuts and missing_parts == 1:
        return rows.withColumn("chunk", F.lit(0))
    values, times = np.array(sorted(cuts), np.int64), np.array([cuts[v] for v in sorted(cuts)], np.int64)
    # Up to a value's own rows one chunk, its rows over as many chunks as it fills parts; the last chunk has no end.
    first = np.concatenate([[0], np.cumsum(times)]) + missing_parts - 1

    @F.pandas_udf("int")
    def chunk_of(missing: pd.Series, ids: pd.Series, marks: pd.Series) -> pd.Series:
        missing, known = missing.to_numpy(bool), ids.to_numpy(np.int64)
        high = (marks.to_numpy(np.int64) >> 32) + (1 << 31)
        at = np.searchsorted(values, known, side="left")
        own = np.zeros(len(known), np.int64)
        inside = at < len(values)
        own[inside] = np.where(values[at[inside]] == known[inside], times[at[inside]], 0)
        return pd.Series(np.where(missing, high * missing_parts >> 32, first[at] + (high * own >> 32)))

    # a column with nulls would reach pandas as floats, which fold large ids
    return rows.withColumn("chunk", chunk_of(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "mark"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W,
                      chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness to each other and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document; the last document is followed
    by the first. Rows are cut by id, busy ids by text hash too, into chunks of
    about `chunk_chars` characters, MAX_CHUNKS or so at most. Each chunk also
    gets the first row of the next one as a guest, so whole texts move once and
    a task reads its chunk as a sorted stream, whatever its length.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "mark"]
    rows = rows.withColumn("mark", F.xxhash64("text"))
    chunked = _chunked(rows, chunk_chars)
    # Only ids and text hashes decide which rows are first in their chunk: one row per chunk.
    firsts = materialize(chunked.groupBy("chunk").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has_id"), *order)).alias("first")),
                         "chunks").collect()
    firsts.sort(key=lambda r: r.chunk)
    if not firsts:
        return rows.select("doc_id", "mark", "text").mapInArrow(_compared(k, w), _RESULT)
    before = {(r.first.doc_id, r.first.mark): firsts[i - 1].chunk for i, r in enumerate(firsts)}
    previous = F.broadcast(rows.sparkSession.createDataFrame(
        [(d, m, c) for (d, m), c in before.items()], "first_id long, first_mark long, before int"))
    hosted = chunked.join(previous, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")), "left")
    # Of several equal first rows each one visits; the chunk's stream takes the first guest and skips the others.
    visits = hosted.select("doc_id", "mark", "text", F.explode(F.when(
        F.col("before").isNull(), F.array(F.struct("chunk", F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct("chunk", F.lit(False).alias("guest")), F.struct(F.col("before").alias("chunk"), F.lit(True).alias("guest"))))).alias("at"))
    placed = visits.select("at.chunk", "at.guest", "doc_id", "text", "mark")
    return (placed.repartition(max(len(firsts), 1), "chunk").sortWithinPartitions("chunk", "guest", *order)
            .select("chunk", "guest", "doc_id", "text").mapInArrow(_compared(k, w), _RESULT))


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
