"""Joins, lookups and graph walks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import HOT_ROWS, first_per_group, in_chunks, running, same


def equi_join(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str], how: str = "inner",
              extra: str | Column | None = None) -> DataFrame:
    """Equality on key pairs with an optional further predicate.

    No hint is given: the planner picks broadcast or sort-merge from sizes, and
    adaptive execution splits skewed partitions.
    """
    pairs = on if isinstance(on, Mapping) else {k: k for k in on}
    shared = [k for k, v in pairs.items() if k == v]
    if len(shared) == len(pairs) and extra is None:
        return left.join(right, list(pairs), how)
    cond = reduce(lambda a, b: a & b, [left[k] == right[v] for k, v in pairs.items()])
    if extra is not None:
        cond = cond & (F.expr(extra) if isinstance(extra, str) else extra)
    return left.join(right, cond, how)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows_per_task: int = HOT_ROWS) -> DataFrame:
    """Inner or left join on `key` where a few keys of `left` hold much of it.

    A key with more than `rows_per_task` rows is hot; there are at most
    rows / rows_per_task of them, which bounds the broadcast list, and it is
    made once. A hot key's rows are spread over as many groups as its rows ask
    for, by a hash of all their columns, and the matching right rows are
    repeated as often.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    hot = (left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_salts"))
           .filter("_salts > 1"))
    hot = F.broadcast(materialize(hot, "hot"))
    others = [c for c, k in left.dtypes if c != key and not k.startswith("map")]
    salts = F.coalesce("_salts", F.lit(1))
    l_side = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("_salts")
    r_side = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return l_side.join(r_side, [key, "_salt"], how).drop("_salt")


def small_cross_join(left: DataFrame, right: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Cartesian product with a side proven small; anything larger is refused."""
    if right.count() > max_rows:
        raise ValueError(f"the right side of a cross join may hold at most {max_rows} rows")
    return left.join(F.broadcast(right))


def many_to_many_join(left: DataFrame, bridge: DataFrame, right: DataFrame, left_on: tuple[str, str],
                      right_on: tuple[str, str], how: str = "inner") -> DataFrame:
    """Two hops over a bridge whose key pairs are made distinct first."""
    pairs = bridge.select(left_on[1], right_on[0]).distinct()
    hop = left.join(pairs, left[left_on[0]] == pairs[left_on[1]], how)
    return hop.join(right, hop[right_on[0]] == right[right_on[1]], how)


def drill_across(facts: Sequence[tuple[DataFrame, Mapping[str, str], Mapping[str, Column]]]) -> DataFrame:
    """Facts aggregated at a shared grain, then full-joined: no fan-out.

    Each fact is (frame, {grain column: expression}, {output: aggregate}).
    """
    out = None
    for df, grain, aggs in facts:
        part = (df.groupBy(*[F.expr(e).alias(g) for g, e in grain.items()])
                .agg(*[c.alias(n) for n, c in aggs.items()]))
        if out is None:
            out, keys = part, list(grain)
            continue
        kept = [c for c in out.columns if c not in keys]
        out = (out.alias("l").join(part.alias("r"), same("l", "r", keys), "full")
               .select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys],
                       *[F.col(f"l.{c}") for c in kept], *[F.col(f"r.{n}") for n in aggs]))
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
            child_where: str = "true", parent_where: str = "true") -> DataFrame:
    """Child rows whose non-null key has no parent; both sides may be filtered."""
    keys = parent.filter(parent_where).select(F.col(parent_key).alias("_pk")).distinct()
    rows = child.filter(child_where).filter(F.col(child_key).isNotNull())
    return rows.join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_rk")), F.col(left_key) == F.col("_rk"), "left_semi")


def key_lookup(df: DataFrame, dictionary: DataFrame, on: Mapping[str, str], defaults: Mapping[str, Any]) -> DataFrame:
    """Attributes of a dictionary with a default per attribute when the key is missing."""
    wanted = dictionary.select(*[F.col(v).alias(f"_k{i}") for i, v in enumerate(on.values())],
                               *[F.col(a).alias(f"_a_{a}") for a in defaults])
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)])
    joined = df.join(wanted, cond, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_a_{a}"), F.lit(d)).alias(a) for a, d in defaults.items()])


DEPTH = 3  # blocks are an eighth of a range or smaller
STEP = 2  # lengths of blocks are powers of 4
MAX_GAP = 12  # a range takes blocks at most 2^12 times shorter than its own
MOST_BROADCAST = 200_000  # blocks that the planner may broadcast


def _instant(value: Column, kind: str) -> Column:
    """A point on the line of 64-bit integers: microseconds, or the number itself."""
    return value.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.unix_micros(value.cast("timestamp"))


def _own_level(length: Column) -> Column:
    """The level whose blocks, of 2^level points, are between an eighth and a 32nd of a range; short ranges have level 0."""
    return F.greatest((F.floor((F.length(F.bin(F.greatest(length, F.lit(0)))) - DEPTH) / STEP) * STEP).cast("int"), F.lit(0))


def _levels_to_use(ranges: Mapping[int, int], points: int) -> dict[int, int]:
    """The level that ranges of each own level take: the same one or a lower one, with the fewest rows in all.

    Every level in use costs a row per point, a range on a lower level than
    its own costs more blocks.
    """
    own = sorted(ranges)
    best: list[tuple[int, list[int]]] = [(0, [])]  # by number of levels served: rows, levels in use
    for served in range(1, len(own) + 1):
        tries = []
        for first in range(served):
            low = own[first]
            if own[served - 1] - low <= MAX_GAP:
                blocks = sum(ranges[n] << (n - low + DEPTH) for n in own[first:served])
                tries.append((best[first][0] + points + blocks, [*best[first][1], low]))
        best.append(min(tries))
    used = best[-1][1]
    return {n: max(u for u in used if u <= n) for n in own}


def interval_candidates(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str,
                        keys: Mapping[str, str] | None = None) -> DataFrame:
    """Points beside the ranges whose blocks they lie in (columns `_r_*`), with `_inside` where they lie in the range.

    A range is stored under the aligned blocks that cover it, whose length
    follows its own, and a point looks up one block for every level in use, 32
    at most. So minutes and decades go together, no key holds more than a
    level's ranges over one block, and four of five candidates or more match.
    Counts of points and of ranges by level say which levels to use: a level
    with few ranges is served by the blocks of a lower one. Open and far ends
    are cut to the time of the points. The planner takes blocks for as small as
    the file of their ranges, so unless few, they are merged, never broadcast.
    """
    kinds, ends = dict(points.dtypes), dict(ranges.dtypes)
    place = _instant(F.col(at), kinds[at])
    seen = points.agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(place).alias("n")).first()
    first, last = F.lit(seen["first"]).cast("bigint"), F.lit(seen["last"]).cast("bigint")
    begin = F.greatest(_instant(F.col(start), ends[start]), first)
    until = F.least(_instant(F.col(end), ends[end]), last)
    side = (ranges.withColumns({"_begin": begin, "_until": until}).filter(F.col("_begin") <= F.col("_until"))
            .withColumn("_own", _own_level(F.col("_until") - F.col("_begin"))))
    counts = {r["_own"]: r["count"] for r in side.groupBy("_own").count().collect()}  # 32 rows at most
    used = _levels_to_use(counts, seen["n"])
    blocks = sum(n << (own - used[own] + DEPTH + STEP) for own, n in counts.items())  # at most
    level = F.coalesce(*[F.when(F.col("_own") == own, F.lit(low)) for own, low in used.items()], F.lit(0))
    block = lambda x, n: F.call_function("shiftright", x, n)
    side = (side.withColumn("_level", level)
            .withColumn("_block", F.explode(F.sequence(block(F.col("_begin"), F.col("_level")), block(F.col("_until"), F.col("_level")))))
            .select("_level", "_block", *[F.col(c).alias(f"_r_{c}") for c in ranges.columns]))
    if blocks > MOST_BROADCAST:
        side = side.hint("merge")
    probes = F.array(*[F.struct(F.lit(n).alias("_level"), block(place, F.lit(n)).alias("_block")) for n in sorted(set(used.values()) or {0})])
    pts = points.withColumn("_probe", F.explode(probes)).select(*points.columns, "_probe._level", "_probe._block")
    cond = (pts["_level"] == side["_level"]) & (pts["_block"] == side["_block"])
    for mine, theirs in (keys or {}).items():
        cond = cond & (F.col(mine) == F.col(f"_r_{theirs}"))
    inside = (F.col(at) >= F.col(f"_r_{start}")) & (F.col(f"_r_{end}").isNull() | (F.col(at) <= F.col(f"_r_{end}")))
    return (pts.join(side, cond, "inner").select(*[pts[c] for c in points.columns], *[F.col(f"_r_{c}") for c in ranges.columns], inside.alias("_inside")))


def _range_totals(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, keys: Mapping[str, str],
                  wanted: Mapping[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ranges that hold points, once each, beside totals of their points.

    Pairs grow with the product of points and ranges, this with their sum:
    every place where a point lies or a range begins or ends goes into one
    order, once, with its number of points. The running count up to a range's
    end less the one before its start is the range's count, its first point is
    the next one from its start, its last point the latest one at its end.
    """
    groups = [f"_k{i}" for i in range(len(keys))]
    spots = lambda df, on, place, n: df.select(
        *[F.col(k).alias(g) for k, g in zip(on, groups)], F.col(place).alias("_place"), F.lit(n).cast("bigint").alias("_n"))
    begun = ranges.filter(F.col(start).isNotNull())
    marks = (spots(points.filter(F.col(at).isNotNull()), keys, at, 1).unionByName(spots(begun, keys.values(), start, 0))
             .unionByName(spots(begun, keys.values(), end, 0)))
    places = marks.groupBy(*groups, "_place").agg(F.sum("_n").alias("_n"))
    places = materialize(places.withColumns({"_open": F.col("_place").isNull(), "_point": F.when(F.col("_n") > 0, F.col("_place"))}), "places")
    # an open end is the one null place of its group, behind all others
    passed = running(places, groups, ["_open", "_place"], {"_seen": ("sum", "_n"), "_last": ("max", "_point")}, hot_rows)
    if "min" in wanted.values():
        passed = running(materialize(passed, "passed"), groups, ["-_open", "-_place"], {"_next": ("min", "_point")}, hot_rows)
    passed = materialize(passed, "passed")
    on = lambda side: reduce(lambda a, b: a & b, [F.col(f"r.`{k}`") == F.col(f"{side}.{g}") for k, g in zip(keys.values(), groups)], F.lit(True))
    held = (begun.alias("r").join(passed.alias("b"), on("b") & (F.col(f"r.`{start}`") == F.col("b._place")))
            .join(passed.alias("e"), on("e") & F.col(f"r.`{end}`").eqNullSafe(F.col("e._place"))))
    count = F.col("e._seen") - F.col("b._seen") + F.col("b._n")
    total = {"count": lambda: count, "min": lambda: F.col("b._next"), "max": lambda: F.col("e._last")}
    kinds = {"count": "bigint", "min": dict(points.dtypes)[at], "max": dict(points.dtypes)[at]}
    hidden = set(keys.values())
    return held.filter(count > 0).select(*[F.col(f"r.`{c}`") for c in ranges.columns if c not in hidden],
                                         *[total[fn]().cast(kinds[fn]).alias(name) for name, fn in wanted.items()])


def interval_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str,
                  keys: Mapping[str, str] | None = None, how: str = "inner",
                  per_range: Mapping[str, str] | None = None) -> DataFrame:
    """Points inside [start, end] of a range, optionally also equal on keys; a null end is open.

    Times, dates or integers. With `how` left, points in no range stay. Where
    only totals of a range's points are wanted, `per_range` names them, {out:
    "count" of the points, "min" or "max" of `at`}: every range that holds
    points comes once beside them, and no pair is made.
    """
    if how not in ("inner", "left"):
        raise ValueError("interval_join supports inner and left")
    if per_range:
        if how != "inner" or not {"count", "min", "max"}.issuperset(per_range.values()):
            raise ValueError("per_range supports count, min and max of an inner join")
        return _range_totals(points, ranges, at, start, end, keys or {}, per_range)
    if how == "left":
        points = materialize(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    hits = interval_candidates(points, ranges, at, start, end, keys).filter("_inside")
    hidden = set((keys or {}).values())
    shown = [c for c in ranges.columns if c not in hidden]
    found = hits.select(*points.columns, *[F.col(f"_r_{c}").alias(c) for c in shown])
    if how == "left":
        found = materialize(found, "hits")
        alone = points.join(found.select("_row").distinct(), "_row", "left_anti")
        found = found.unionByName(alone, allowMissingColumns=True).drop("_row")
    return found


def range_lookup(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, keys: Mapping[str, str],
                 row_key: Sequence[str], strategy: str = "min") -> DataFrame:
    """At most one range per point: the earliest ("min") or latest ("max") starting one.

    `row_key` names the columns that identify a point. Points go in once by
    themselves and once per range they lie in; the best of a point's rows stays.
    """
    hits = interval_join(points, ranges, at, start, end, keys).withColumn("_none", F.lit(0))
    every = hits.unionByName(points.withColumn("_none", F.lit(1)), allowMissingColumns=True)
    sign = "" if strategy == "min" else "-"
    return first_per_group(every, row_key, ["_none", f"{sign}{start}", f"{sign}{end}"]).drop("_none")


_V4 = r"^\d{1,3}(\.\d{1,3}){3}$"
_LOWEST = -(1 << 63)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _v4_number(text: Column) -> Column:
    """Dotted text as a number, NULL for anything else."""
    octets = F.transform(F.split(text, r"\."), lambda o: o.try_cast("bigint"))
    joined = _let(octets, lambda x: F.when(F.forall(x, lambda o: o <= 255), F.aggregate(x, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o)))
    return F.when(text.rlike(_V4), joined)


def _v6_key(text: Column) -> Column:
    listed = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":", -1))
    hex_of = lambda x: F.lower(F.hex(x))
    flip = lambda x: x.bitwiseXOR(F.lit(_LOWEST))
    half = lambda groups, first: flip(F.aggregate(F.slice(groups, first, 4), F.lit(0).cast("bigint"),
                                                  lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint"))))

    def key(every):
        good = F.forall(every, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(good, F.struct(half(every, 1).alias("hi"), half(every, 5).alias("lo")))

    def filled(sides):
        left, right = sides["left"], sides["right"]
        missing = 8 - F.size(left) - F.size(right)
        whole = F.when(sides["gap"], missing >= 1).otherwise(missing == 0)
        return F.when(whole, _let(F.concat(left, F.array_repeat(F.lit("0"), missing), right), key))

    def split(halves):
        sides = F.struct(listed(halves[0]).alias("left"), listed(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right"),
                         (F.size(halves) == 2).alias("gap"))
        return F.when(F.size(halves) <= 2, _let(sides, filled))

    # a dotted tail becomes two groups of its own
    tail = _v4_number(F.regexp_extract(text, r":(\d+(?:\.\d+){3})$", 1))
    spelled = _let(tail, lambda n: F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), hex_of(F.shiftrightunsigned(n, 16)), F.lit(":"),
                                            hex_of(n.bitwiseAND(F.lit(65535)))))
    plain = F.when(text.contains("."), spelled).otherwise(text)
    return _let(F.split(plain, "::", -1), split)


def ip_key(ip: str | Column) -> Column:
    """An address as (hi, lo), two longs whose signed order is the order of the 128 bits; NULL for anything else.

    IPv6 with `::` and dotted tails, IPv4 as ::ffff:a.b.c.d.
    """
    text = F.col(ip) if isinstance(ip, str) else ip
    flip = lambda x: x.bitwiseXOR(F.lit(_LOWEST))
    four = lambda n: F.struct(F.lit(_LOWEST).alias("hi"), flip(n.bitwiseOR(F.lit(0xFFFF << 32))).alias("lo"))
    return F.when(text.rlike(_V4), _let(_v4_number(text), lambda n: F.when(n.isNotNull(), four(n)))).otherwise(_v6_key(text))


def _prefix_table(prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows with the first and last address of their prefix and its length; text that is no prefix goes, of equal prefixes the least row stays."""
    parts = F.split(prefix, "/")
    given = F.when(F.get(parts, F.lit(1)).rlike(r"^\d{1,3}$") & (F.size(parts) == 2), F.get(parts, F.lit(1)).try_cast("int"))
    size = F.when(F.get(parts, F.lit(0)).rlike(_V4), F.when(given <= 32, given + 96)).otherwise(F.when(given <= 128, given))
    rows = prefixes.withColumns({"_key": ip_key(F.get(parts, F.lit(0))), "_size": size}).filter("_key is not null and _size is not null")
    # bits of each half that lie beyond the prefix
    rest = lambda bits: F.when(bits >= 64, F.lit(-1).cast("bigint")).when(bits <= 0, F.lit(0).cast("bigint")).otherwise(
        F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits)))
    free = {"hi": rest(64 - F.col("_size")), "lo": rest(128 - F.col("_size"))}
    free["lo"] = F.when(F.col("_size") <= 64, F.lit(-1).cast("bigint")).otherwise(free["lo"])
    # order is flipped in the highest bit, which masks see through
    value = lambda half: F.col(f"_key.{half}").bitwiseXOR(F.lit(_LOWEST))
    flip = lambda x: x.bitwiseXOR(F.lit(_LOWEST))
    rows = rows.withColumns({f"_from_{h}": flip(value(h).bitwiseAND(F.bitwise_not(free[h]))) for h in free})
    rows = rows.withColumns({f"_to_{h}": flip(F.col(f"_from_{h}").bitwiseXOR(F.lit(_LOWEST)).bitwiseOR(free[h])) for h in free}).drop("_key")
    order = [c for c, k in prefixes.dtypes if not k.startswith("map")]
    return first_per_group(rows, ["_from_hi", "_from_lo", "_size"], order)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nested prefixes of one chunk, sorted by first address and length, to disjoint ranges that name the innermost one.

    The chunk's rows come after those prefixes that are open where it begins,
    129 at most. Prefixes lie inside each other or apart, so the open ones form
    a stack, and a range ends where the next prefix begins or the top one ends.
    """
    whole = lambda hi, lo: ((hi + (1 << 63)) << 64) | (lo + (1 << 63))
    halves = lambda x: ((x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63))
    stack, at, end, limit, out = [], 0, 0, None, []

    def close(until):
        """Ranges up to, not including, `until`; prefixes that end before it leave the stack."""
        nonlocal at
        while stack and at < until:
            last, name = stack[-1]
            if at <= min(last, until - 1):
                out.append((*halves(at), *halves(min(last, until - 1)), *name))
                at = min(last, until - 1) + 1
            if last < until:
                stack.pop()
        at = until

    def rows():
        done = pd.DataFrame(out, columns=["hi", "lo", "to_hi", "to_lo", "from_hi", "from_lo", "size"])
        out.clear()
        return done

    for batch in batches:
        for row in batch.itertuples(index=False):
            first, last, size = whole(row.from_hi, row.from_lo), whole(row.to_hi, row.to_lo), row.size_
            if row.chunk != limit:
                if limit is not None:
                    close(end)
                stack.clear()
                limit, at, end = row.chunk, whole(row.cut_hi, row.cut_lo), 1 << 128 if row.final else whole(row.end_hi, row.end_lo)
            if first > at:
                close(first)
            stack.append((last, (row.from_hi, row.from_lo, size)))
        yield rows()
    if limit is not None:
        close(end)
        yield rows()


_RANGE = "hi bigint, lo bigint, to_hi bigint, to_lo bigint, from_hi bigint, from_lo bigint, size int"


def flatten_prefixes(table: DataFrame, chunk_rows: int = HOT_ROWS) -> DataFrame:
    """Disjoint ranges (hi, lo) .. (to_hi, to_lo) of addresses, each with the innermost prefix it lies in (from_hi, from_lo, size)."""
    plain = table.select(*[F.col(f"_{c}").alias(c) for c in ("from_hi", "from_lo", "to_hi", "to_lo", "size")])
    chunked = in_chunks(plain, [], ["from_hi", "from_lo", "size"], plain.count(), chunk_rows).drop("_row")
    firsts = chunked.groupBy("_chunk").agg(F.min(F.struct("from_hi", "from_lo", "size")).alias("cut"))
    following = Window.orderBy("_chunk")  # one row per chunk
    highest = F.lit((1 << 63) - 1)
    cuts = materialize(firsts.withColumn("end", F.lead("cut").over(following)).select(
        "_chunk", F.col("cut.from_hi").alias("cut_hi"), F.col("cut.from_lo").alias("cut_lo"), F.col("cut.size").alias("cut_size"),
        F.coalesce("end.from_hi", highest).alias("end_hi"), F.coalesce("end.from_lo", highest).alias("end_lo"), F.col("end").isNull().alias("final")), "cuts")
    # prefixes open at a cut: one per length at most, found by the cut's own prefix of that length
    sizes = plain.agg(F.collect_set("size")).scalar()
    flip = lambda x: x.bitwiseXOR(F.lit(_LOWEST))
    keep = lambda bits: F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, F.lit(-1).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), 64 - bits))
    probes = cuts.withColumn("_sizes", sizes).withColumn("size", F.explode("_sizes")).select(
        "_chunk", "size", "cut_hi", "cut_lo", "cut_size", flip(flip(F.col("cut_hi")).bitwiseAND(keep(F.col("size")))).alias("from_hi"),
        flip(flip(F.col("cut_lo")).bitwiseAND(keep(F.col("size") - 64))).alias("from_lo"))
    before = F.struct("from_hi", "from_lo", "size") < F.struct("cut_hi", "cut_lo", "cut_size")
    opened = plain.join(probes.filter(before), ["from_hi", "from_lo", "size"]).select(*plain.columns, "_chunk")
    rows = chunked.select(*plain.columns, "_chunk").unionByName(opened).join(F.broadcast(cuts), "_chunk")
    wanted = rows.select("from_hi", "from_lo", "to_hi", "to_lo", F.col("size").alias("size_"), F.col("_chunk").alias("chunk"), "cut_hi", "cut_lo", "end_hi", "end_lo", "final")
    return (wanted.repartition("chunk").sortWithinPartitions("chunk", "from_hi", "from_lo", "size_").mapInPandas(_sweep, _RANGE))


def ip_prefix_lookup(df: DataFrame, prefixes: DataFrame, ip: str, prefix: str = "prefix", chunk_rows: int = HOT_ROWS) -> DataFrame:
    """Longest matching CIDR prefix of each address, IPv4 and IPv6; other text matches nothing.

    Prefixes are flattened into disjoint ranges, so one pass over addresses and
    range starts in order finds the last range that begins at or before an
    address, whatever lengths there are. Distinct addresses are looked up once.
    """
    table = materialize(_prefix_table(prefixes, prefix), "prefixes")
    ranges = flatten_prefixes(table, chunk_rows)
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_key", ip_key("_ip")).filter("_key is not null")
    name = F.struct("hi", "lo", "to_hi", "to_lo", "from_hi", "from_lo", "size")
    starts = ranges.select("hi", "lo", F.lit(0).alias("_kind"), name.alias("_range"), F.lit(None).cast("string").alias("_ip"))
    merged = starts.unionByName(addresses.select("_key.hi", "_key.lo", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_range"].dataType).alias("_range"), "_ip"))
    merged = materialize(merged, "merged")
    passed = running(merged, [], ["hi", "lo", "_kind"], {"_last": ("max", "_range")}, chunk_rows).filter("_kind = 1")
    within = (F.col("hi") < F.col("_last.to_hi")) | ((F.col("hi") == F.col("_last.to_hi")) & (F.col("lo") <= F.col("_last.to_lo")))
    hits = passed.filter(within).select("_ip", *[F.col(f"_last.{c}").alias(f"_h_{c}") for c in ("from_hi", "from_lo", "size")])
    match = reduce(lambda a, b: a & b, [F.col(f"_h_{c}") == F.col(f"_{c}") for c in ("from_hi", "from_lo", "size")])
    best = hits.join(table, match).select("_ip", *prefixes.columns)
    return df.join(best, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def same_period_join(df: DataFrame, keys: Sequence[str], period: str, values: Sequence[str], months: int = 12,
                     prefix: str = "prior_") -> DataFrame:
    """Each period row beside the row `months` earlier (self join on the shifted period)."""
    before = df.select(*keys, F.add_months(period, months).alias(period),
                       *[F.col(v).alias(f"{prefix}{v}") for v in values])
    cols = [*keys, period]
    return (df.alias("l").join(before.alias("r"), same("l", "r", cols), "left")
            .select("l.*", *[F.col(f"r.{prefix}{v}") for v in values]))


def ancestors(df: DataFrame, node: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) pairs by walking parent links.

    One join per level against the link table; a level is written to the shared
    folder so that the plan stays short. Walks until no link is left, or to
    `max_depth`; a cycle is an error.
    """
    links = df.filter(F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    level = materialize(links.select(F.col("_n").alias("node"), F.col("_p").alias("ancestor")), "ancestors")
    out, depth = level.withColumn("distance", F.lit(1)), 1
    while depth != max_depth:
        if not level.filter(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the hierarchy contains a cycle")
        level = materialize(level.join(links, F.col("ancestor") == F.col("_n"))
                            .select("node", F.col("_p").alias("ancestor")), "ancestors")
        depth += 1
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("distance", F.lit(depth)))
    return out


def lineage_traverse(edges: DataFrame, roots: DataFrame, direction: str = "downstream",
                     max_depth: int | None = None) -> DataFrame:
    """(node, depth) reachable from the roots over `source`, `target` edges; each node once.

    Walks to `max_depth`, or until no new node is reached.
    """
    src, dst = ("source", "target") if direction == "downstream" else ("target", "source")
    step = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to"))
    frontier = materialize(roots.select("node").distinct().withColumn("depth", F.lit(0)), "lineage")
    seen, depth = frontier, 0
    while depth != max_depth:
        depth += 1
        reached = (frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
                   .join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        frontier = materialize(reached, "lineage")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact_counts(edges: DataFrame, roots: DataFrame, kinds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Downstream nodes per kind; `kinds` maps node to kind."""
    hit = lineage_traverse(edges, roots, "downstream", max_depth).filter("depth > 0")
    return hit.join(kinds, "node").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
