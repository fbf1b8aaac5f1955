"""Tables kept as batch logs: every micro-batch writes one folder, readers combine them.

A micro-batch costs work in proportion to the batch, not to the table. A
manifest, one small file that a commit replaces by the next number, lists the
live folders, how far each stream has come and what may be deleted; nothing is
found by listing the log. A batch delivered twice is known by its stream and
number. A folder that is not in the manifest is nothing: a job that dies between
writing and committing leaves the table as it was, and its next run writes the
same folder again.

Folders have tiers. When a tier holds `fan` of them they are combined into one of
the next tier, so n batches leave about fan * log(n) live folders and a row is
rewritten log(n) times. Folded folders are deleted one commit later, so that a
reader who began with the manifest before still finds them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_per_group, same
from ..operators.states import State, build_states, finish_states, merge_states
from ..sources.load import scd2_apply_changes

FAN = 8
BUCKETS = 64
EMPTY = {"next": 0, "streams": {}, "folders": [], "settled": {}, "dead": []}


class BatchLog:
    """Live folders with their tiers. One stream at a time may write."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan

    # ---- the manifest

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, suffix: str) -> list[int]:
        """Manifests, of which a commit keeps two."""
        files, where = self._file("manifest")
        if not files.exists(where):
            return []
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return sorted(int(m[1]) for m in (re.fullmatch(rf"(\d+)\.{suffix}", n) for n in names) if m)

    def manifest(self) -> dict:
        numbers = self._numbers("json")
        if not numbers:
            return json.loads(json.dumps(EMPTY))
        files, where = self._file(f"manifest/{numbers[-1]:012d}.json")
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict, dead: Sequence[str] = ()) -> None:
        """Make a state the live one; `dead` folders go with the commit after it."""
        gone, state["dead"] = state["dead"], list(dead)
        known = self._numbers("json")
        number = max([*known, *self._numbers("claim")], default=0) + 1
        files, claim = self._file(f"manifest/{number:012d}.claim")
        if not files.createNewFile(claim):
            raise RuntimeError(f"another writer took commit {number} of {self.path}")
        _, draft = self._file(f"manifest/{number:012d}.draft")
        out = files.create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        files.rename(draft, self._file(f"manifest/{number:012d}.json")[1])
        for old in known[:-1]:
            self._delete(f"manifest/{old:012d}.json")
        for old in self._numbers("claim"):
            self._delete(f"manifest/{old:012d}.claim")
        for name in gone:
            self._delete(name)

    def _delete(self, name: str) -> None:
        files, where = self._file(name)
        files.delete(where, True)

    # ---- folders

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _load(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def combine(self, rows: DataFrame) -> DataFrame:
        """Rows of several folders as rows of one, `batch` included; combining in any grouping gives the same table."""
        raise NotImplementedError

    def put(self, batch: DataFrame, batch_id: int, stream: str = "0") -> bool:
        """Log a batch unless the stream's batch of this number is in already."""
        state = self.manifest()
        if batch_id <= state["streams"].get(stream, -1):
            return False
        place = state["next"]
        name = f"log/{place:012d}"
        self._write(batch.withColumn("batch", F.lit(place).cast("long")), name)
        state["next"] = place + 1
        state["streams"][stream] = batch_id
        state["folders"].append({"name": name, "tier": 0})
        self._commit(state)
        self._tidy(state)
        return True

    def _tidy(self, state: dict) -> None:
        """Combine full tiers from the lowest up."""
        tier = 0
        while True:
            full = [f for f in state["folders"] if f["tier"] == tier]
            if len(full) < self.fan:
                if all(f["tier"] <= tier for f in state["folders"]):
                    return
            else:
                self._fold(state, full, tier + 1)
            tier += 1

    def _fold(self, state: dict, folders: list[dict], tier: int) -> None:
        names = [f["name"] for f in folders]
        name = f"log/{state['next']:012d}-{tier}"
        self._write(self.combine(self._load(names)), name)
        state["folders"] = [f for f in state["folders"] if f not in folders] + [{"name": name, "tier": tier}]
        self._commit(state, names)

    def rows(self) -> DataFrame | None:
        """All live rows with their batch number (column `batch`)."""
        folders = [f["name"] for f in self.manifest()["folders"]]
        return self._load(folders) if folders else None

    def read(self) -> DataFrame:
        raise NotImplementedError

    def compact(self) -> DataFrame:
        """Fold all folders into one; later reads start from it."""
        state = self.manifest()
        if len(state["folders"]) > 1:
            self._fold(state, state["folders"], max(f["tier"] for f in state["folders"]) + 1)
        return self.read()


class UpsertLog(BatchLog):
    """Latest row per key; `version` orders rows of one key, the place in the log and then all columns break ties."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str | None = None, fan: int = FAN):
        super().__init__(spark, path, fan)
        self.keys, self.version = list(keys), version

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [f"-{c}" for c, k in rows.dtypes if c not in (*self.keys, self.version, "batch") and not k.startswith("map")]
        order = ([f"-{self.version}"] if self.version else []) + (["-batch"] if "batch" in rows.columns else []) + rest
        return first_per_group(rows, self.keys, order or list(self.keys))

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "0") -> None:
        """Log one batch, reduced to its newest row per key."""
        self.put(self._newest(batch), batch_id, stream)

    def combine(self, rows: DataFrame) -> DataFrame:
        return self._newest(rows)

    def read(self) -> DataFrame:
        return self._newest(self.rows()).drop("batch")


class SumLog(BatchLog):
    """Per-key additive totals; each batch adds its own partial totals."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], totals: dict[str, Column], fan: int = FAN):
        super().__init__(spark, path, fan)
        self.keys, self.totals = list(keys), totals

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "0") -> None:
        self.put(batch.groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.totals.items()]), batch_id, stream)

    def combine(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.totals], F.max("batch").alias("batch"))

    def read(self) -> DataFrame:
        return self.rows().groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.totals])


class RollupLog(BatchLog):
    """Per-key aggregates of any kind in `operators.states`, kept as states that merge and finished on read."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], states: Mapping[str, State], fan: int = FAN):
        super().__init__(spark, path, fan)
        self.keys, self.states = list(keys), dict(states)

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "0") -> None:
        self.put(build_states(batch, self.keys, self.states), batch_id, stream)

    def combine(self, rows: DataFrame) -> DataFrame:
        last = rows.agg(F.max("batch")).scalar()
        return merge_states(rows, self.keys, self.states).withColumn("batch", last)

    def read(self, keys: Sequence[str] | None = None) -> DataFrame:
        """Finished aggregates by the log's keys or some of them."""
        return finish_states(self.rows(), self.keys if keys is None else list(keys), self.states)


class HistoryLog(BatchLog):
    """Version history of a change feed whose rows carry the time of their change.

    The log keeps the changes, also those that alter nothing now, since a late
    one may come before them. Settled changes lie in buckets by key, beside the
    versions they make. A read takes settled versions as they are, but for the
    keys that the tail of newer batches names: their changes are put in order
    anew. The tail is settled, bucket by bucket, once it has a `share` of the
    settled rows, so a row is rewritten a bounded number of times for each
    doubling of the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], tracked: Sequence[str], changed_at: str, fan: int = FAN,
                 buckets: int = BUCKETS, share: float = 0.25):
        super().__init__(spark, path, fan)
        self.keys, self.tracked, self.changed_at, self.buckets, self.share = list(keys), list(tracked), changed_at, buckets, share

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "0") -> None:
        self.put(self._changes(batch), batch_id, stream)

    def _changes(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, *self.tracked, self.changed_at).distinct()

    def combine(self, rows: DataFrame) -> DataFrame:
        return self._changes(rows).withColumn("batch", rows.agg(F.max("batch")).scalar())

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _versions(self, changes: DataFrame) -> DataFrame:
        return scd2_apply_changes(None, changes, self.keys, self.tracked, self.changed_at)

    def _settled(self, state: dict, kind: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        wanted = [f for b, f in state["settled"].items() if buckets is None or int(b) in buckets]
        return self._load([f"{f['name']}/{kind}/_bucket={f['bucket']}" for f in wanted]) if wanted else None

    def _touched(self, tail: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._bucketed(tail).select("_bucket").distinct().collect())  # `buckets` values at most

    def _tidy(self, state: dict) -> None:
        super()._tidy(state)
        if any(f["tier"] > 0 for f in state["folders"]):
            tail = self._load([f["name"] for f in state["folders"]]).count()
            if tail >= self.share * sum(f["rows"] for f in state["settled"].values()):
                self._settle(state)

    def _settle(self, state: dict) -> None:
        """Move the tail into its buckets; other buckets stay as they are."""
        folders = [f["name"] for f in state["folders"]]
        if not folders:
            return
        tail = self._changes(self._load(folders))
        buckets = self._touched(tail)
        before = self._settled(state, "changes", buckets)
        changes = self._bucketed(self._changes(tail if before is None else before.unionByName(tail)))
        name = f"settled/{state['next']:012d}"
        changes.repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}/changes")
        stored = self.spark.read.parquet(f"{self.path}/{name}/changes")
        versions = self._bucketed(self._versions(stored.drop("_bucket")))
        versions.repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}/versions")
        sizes = {r["_bucket"]: r["count"] for r in stored.groupBy("_bucket").count().collect()}
        dead = folders + [f"{state['settled'][str(b)]['name']}/{kind}/_bucket={b}" for b in buckets if str(b) in state["settled"] for kind in ("changes", "versions")]
        state["settled"].update({str(b): {"name": name, "bucket": b, "rows": sizes[b]} for b in buckets})
        state["folders"] = []
        self._commit(state, dead)

    def read(self) -> DataFrame:
        state = self.manifest()
        folders = [f["name"] for f in state["folders"]]
        if not folders:
            return self._settled(state, "versions")
        tail = self._changes(self._load(folders))
        if not state["settled"]:
            return self._versions(tail)
        buckets = self._touched(tail)
        named = tail.select(*self.keys).distinct()
        before, beside = self._settled(state, "changes", buckets), self._settled(state, "versions", buckets)
        out = self._settled(state, "versions", sorted({int(b) for b in state["settled"]} - set(buckets)))
        changes = tail
        if before is not None:
            changes = tail.unionByName(before.alias("l").join(named.alias("r"), same("l", "r", self.keys), "left_semi"))
            kept = beside.alias("l").join(named.alias("r"), same("l", "r", self.keys), "left_anti")
            out = kept if out is None else out.unionByName(kept)
        anew = self._versions(changes)
        return anew if out is None else out.select(*anew.columns).unionByName(anew)

    def compact(self) -> DataFrame:
        self._settle(self.manifest())
        return self.read()


def each_batch(apply: Callable[[DataFrame, int, str], None], checkpoint: str = ""):
    """Adapter for `foreachBatch` that skips empty batches; a stream goes by its checkpoint."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply(batch, batch_id, stream)

    return run
