"""Near duplicates by SimHash with a generalised pigeonhole search.

Method: a 64-bit fingerprint takes the majority of every bit over a text's word
shingles. Bits that vary together are grouped into the same partition; each
partition gets its own threshold, one of them being passed by any two
fingerprints within the distance. Dynamic programming picks the thresholds with
the least estimated number of probes and candidates, and the number of
partitions is that with the least cost: few rows take narrow partitions and few
probes, many rows wide ones and thresholds above zero, so candidates per
fingerprint do not follow the number of fingerprints. Costs come from the pairs
of a bounded sample and from the shares of single bits over all rows; they
choose the layout, every layout finds the same links. Fingerprints are probed
with all values within the threshold, candidates are verified, and links are
joined into components.

Equal fingerprints are one node, so copies form no pairs. Every bucket is first
linked to its smallest and largest fingerprint; after that only fingerprints of
different components are compared, and those of a bucket's largest component
never with each other. No link between components is lost, and a hot bucket of
near copies makes no square of candidates.

Defined results: a null or empty text has fingerprint zero and links like any
other; a component's id is its smallest document id, null if it has none;
repeated rows stay repeated, but where rows are dropped one row of a component
stays; an empty table gives an empty result; other columns are ignored or,
where rows are dropped, carried along.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups, materialize, merged, pick
from tidemark.llm.graph import components

BITS = 64
SAMPLE = 4096  # fingerprints whose pairs tell costs
MAX_PARTITIONS = 8
MAX_PROBES = 1 << 10


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of a text: A-Z lower-cased, words between white space, shingles joined by a space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[last:last + n].tolist())),
                         np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        octets = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 row_col: str | None = None) -> DataFrame:
    """(doc_id, print): fingerprints as signed 64-bit numbers; with `row_col`, that column as `row` too."""
    extra = ["row"] if row_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                                             ["doc_id", "print", *extra])

    rows = pick(docs, doc_id=id_col, text=text_col, **({"row": row_col} if row_col else {})).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, print long" + (", row long" if row_col else ""))


def bit_correlations(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """64 x 64 correlations of the bits over all fingerprints, the share of ones of each bit, and the rows; what reaches the driver is 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            prints = batch.column(0).to_numpy().astype(np.int64)
            for at in range(0, len(prints), 65536):
                octets = prints[at:at + 65536].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(both.ravel())], ["i", "j", "together"])

    sums = np.zeros((BITS, BITS))
    found = nodes.select("print").mapInArrow(run, "i int, j int, together double")
    for row in found.groupBy("i", "j").agg(F.sum("together").alias("together")).collect():
        sums[row.i, row.j] = row.together
    n = max(nodes.count(), 1)
    share = np.diag(sums) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return (sums / n - np.outer(share, share)) / np.outer(spread, spread), share, n


def group_bits(correlations: np.ndarray, partitions: int) -> list[list[int]]:
    """Greedy grouping: a partition starts with the strongest pair left and takes the bit nearest to all it has."""
    strength = np.abs(correlations) - np.eye(BITS) * 2
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = BITS // partitions + (k < BITS % partitions)
        rest = sorted(left)
        inner = strength[np.ix_(rest, rest)]
        group = [rest[i] for i in np.unravel_index(inner.argmax(), inner.shape)] if size > 1 else [rest[0]]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(strength[np.ix_(group, rest)].mean(axis=0).argmax())])
        left -= set(group)
        groups.append(group)
    return groups


def masks_within(width: int, distance: int) -> list[int]:
    """All bit masks of a width with at most `distance` ones."""
    return [sum(1 << b for b in chosen) for k in range(distance + 1) for chosen in itertools.combinations(range(width), k)]


def pair_shares(sample: np.ndarray, shares: np.ndarray, bits: list[int], distance: int) -> list[float]:
    """Estimated share of all pairs that differ in at most t of the bits, for t = 0 .. distance.

    The sample's pairs show what goes together; what is too rare for them comes
    from the single bits, as if they were independent.
    """
    alike = np.array([1.0])
    for bit in bits:
        differ = 2 * shares[bit] * (1 - shares[bit])
        alike = np.append(alike * (1 - differ), 0) + np.append(0, alike * differ)
    independent = np.cumsum(alike[:distance + 1])
    seen = np.zeros(distance + 1)
    if len(sample) > 1:
        own = sum(((sample >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i) for i, bit in enumerate(bits))
        for first in range(0, len(own), 512):
            apart = np.bitwise_count(own[first:first + 512, None] ^ own[None, :])
            seen += [(apart <= t).sum() for t in range(distance + 1)]
        seen = (seen - len(own)) / (len(own) * (len(own) - 1.0))
    return np.maximum(independent, seen).tolist()


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Least cost and a threshold for each partition, -1 for none, adding up to distance - partitions + 1.

    `costs` are those of the thresholds 0 .. distance of each partition.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:  # state: sum of (threshold + 1) so far
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (price, chosen) in best.items():
            for t, more in enumerate([0.0, *own], -1):
                key = spent + t + 1
                if key <= distance + 1 and (key not in step or price + more < step[key][0]):
                    step[key] = (price + more, [*chosen, t])
        best = step
    return best[distance + 1]


def choose_layout(correlations: np.ndarray, shares: np.ndarray, rows: int, sample: np.ndarray, distance: int,
                  partitions: int | None = None) -> tuple[list[list[int]], list[int], float]:
    """Groups of bits, their thresholds, and the estimated probes and candidates of a fingerprint."""
    best = None
    for number in range(2, MAX_PARTITIONS + 1) if partitions is None else [partitions]:
        groups = group_bits(correlations, number)
        costs = []
        for bits in groups:
            probes = [sum(math.comb(len(bits), k) for k in range(t + 1)) for t in range(distance + 1)]
            found = pair_shares(sample, shares, bits, distance)
            # a threshold of too many probes is none to write down as values
            costs.append([p + rows * f if p <= MAX_PROBES else math.inf for p, f in zip(probes, found)])
        cost, thresholds = allocate(costs, distance)
        if best is None or cost < best[2]:
            best = groups, thresholds, cost
    if not math.isfinite(best[2]):
        raise ValueError(f"no layout of {partitions} partitions has thresholds of at most {MAX_PROBES} probes")
    return best


def _value(bits: list[int]) -> Column:
    """The bits of a partition as one number."""
    parts = [F.shiftleft(F.shiftrightunsigned("print", b).bitwiseAND(F.lit(1)), i) for i, b in enumerate(bits)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _parts(groups: list[list[int]], masks: list[list[int]] | None = None) -> Column:
    """Array of (part, value): a fingerprint's own values, or all values its probes look up."""
    own = [F.struct(F.lit(i).alias("part"), _value(bits).alias("value")) for i, bits in enumerate(groups)]
    if masks is None:
        return F.array(*own)

    def lookups(i):
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks[i])), lambda m: F.struct(
            F.lit(i).alias("part"), own[i]["value"].bitwiseXOR(m).alias("value")))

    return F.concat(*(lookups(i) for i in range(len(own)) if masks[i]))


def near_links(nodes: DataFrame, distance: int = 4, partitions: int | None = None) -> DataFrame:
    """(node, root) of all fingerprints `print` within the distance of another one; root names the component.

    `partitions` fixes their number, which is otherwise chosen by cost. Tables
    exploded into values or probes are merged, not broadcast, by their real rows.
    """
    order = F.xxhash64("print")
    sample = nodes.select("print").orderBy(order).limit(SAMPLE).toArrow()["print"].to_numpy().view(np.uint64)
    correlations, shares, rows = bit_correlations(nodes)
    groups, thresholds, _ = choose_layout(correlations, shares, rows, sample, distance, partitions)
    index = materialize(nodes.select("print", F.explode(_parts(groups)).alias("x")).select("print", "x.part", "x.value"), "index")
    ends = materialize(index.groupBy("part", "value").agg(
        F.min("print").alias("low"), F.max("print").alias("high"), F.count(F.lit(1)).alias("n")), "buckets")
    masks = [masks_within(len(bits), t) if t >= 0 else [] for bits, t in zip(groups, thresholds)]
    values, lookups = rows * len(groups), rows * sum(map(len, masks))

    hubs = index.join(merged(ends.where("n > 1"), values), ["part", "value"]).select(
        F.col("print").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    hub_links = hubs.where((F.col("a") != F.col("b")) & _near("a", "b", distance)).distinct()
    first = components(materialize(hub_links, "hub_links"))

    named = nodes.join(merged(first, rows), F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("root", "print").alias("label"))
    named = materialize(named, "named")
    indexed = materialize(named.select("print", "label", F.explode(_parts(groups)).alias("x"))
                          .select("print", "label", "x.part", "x.value"), "indexed")
    # The largest component of every bucket that has several.
    sizes = indexed.groupBy("part", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    main = materialize(sizes.groupBy("part", "value").agg(F.max(F.struct("n", "label"))["label"].alias("main")), "main")
    held = indexed.join(merged(main, values), ["part", "value"]).select(
        "part", "value", (F.col("label") == F.col("main")).alias("in_main"), F.col("print").alias("b"), F.col("label").alias("label_b"))
    probes = (named.select("print", "label", F.explode(_parts(groups, masks)).alias("x"))
              .select("print", "label", "x.part", "x.value").join(merged(main, values + lookups), ["part", "value"])
              .select("part", "value", F.explode(F.when(F.col("label") == F.col("main"), F.array(F.lit(False)))
                                                 .otherwise(F.array(F.lit(True), F.lit(False)))).alias("in_main"),
                      F.col("print").alias("a"), F.col("label").alias("label_a")))
    found = probes.join(merged(held, values + lookups), ["part", "value", "in_main"]).where(
        (F.col("label_a") != F.col("label_b")) & _near("a", "b", distance))
    bridges = materialize(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "bridges")
    # Components of components: bridges join labels, first links join prints to labels.
    return components(bridges.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    distance: int = 4, partitions: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest id reachable over links of `distance` bits."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")), "nodes")
    roots = nodes.join(merged(near_links(nodes, distance, partitions), nodes.count()), F.col("print") == F.col("node"), "left").select(
        "print", "first_id", "members", F.coalesce("root", "print").alias("root"))
    roots = materialize(roots, "roots")
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    entries = materialize(join_groups(roots, ids, ["root"], roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), roots.count())
                          .select("print", "component_id", "members"), "components")
    joined = join_groups(rows, entries, ["print"], entries.select("print", F.col("members").alias("n")), rows.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         distance: int = 4, partitions: int | None = None) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, a null id after all others, then the first row."""
    lower = [c.lower() for c in docs.columns]
    id_at, text_at = (docs.columns.index(c) if c in docs.columns else lower.index(c.lower()) for c in (id_col, text_col))
    names = [f"_c{i}" for i in range(len(lower))]
    # Two passes share the row numbers, so they are stored.
    rows = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    prints = materialize(fingerprints(rows, names[id_at], names[text_at], shingle, "row"), "prints")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = materialize(prints.groupBy("print").agg(F.min(best).alias("best")), "nodes")
    roots = nodes.join(merged(near_links(nodes, distance, partitions), nodes.count()), F.col("print") == F.col("node"), "left").select(
        "best", F.coalesce("root", "print").alias("root"))
    stay = roots.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("stay"))
    return rows.join(stay, F.col("row") == F.col("stay"), "left_semi").select(*names).toDF(*docs.columns)
