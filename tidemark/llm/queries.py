"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language_model,
    merkle,
    mix,
    quality,
    secrets,
    simhash,
    token_count,
    toxicity,
    winnow,
)
from tidemark.llm.common import crc_remainder, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_WEIGHTS, MIX_OTHER = corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_OTHER
MIX_EPOCHS, MIX_SEED = corpus_pipeline.MIX_EPOCHS, corpus_pipeline.MIX_SEED


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def mix_sql(table: str = "documents", columns: str = "doc_id, source, text") -> str:
    """SQL of `mix_sources` with the weights above over a table or subquery."""
    total = sum(MIX_WEIGHTS.values()) + MIX_OTHER
    named = ", ".join(f"('{s}', {w / total!r}::double)" for s, w in MIX_WEIGHTS.items())
    return f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(CASE WHEN source IN ({', '.join(f"'{s}'" for s in MIX_WEIGHTS)}) THEN source END, '*other') AS grp,
         coalesce(CAST(doc_id AS varchar), md5(coalesce(text, ''))) AS nm FROM {table}),
share(grp, share) AS (VALUES {named}, ('*other', {MIX_OTHER / total!r}::double)),
sizes AS (SELECT grp, sum(coalesce(length(text), 0)) AS size FROM d GROUP BY grp),
rates AS (
  SELECT grp, CASE WHEN size > 0 THEN share * {MIX_EPOCHS} * (SELECT sum(size) FROM sizes) / size ELSE 0.0 END AS rate
  FROM sizes JOIN share USING (grp)),
draws AS (SELECT grp, rate, greatest(1, ceil(rate / {mix.DRAW_MEAN}))::int AS m FROM rates),
cdf AS (
  SELECT grp, rate, m, 0 AS k, exp(-rate / m) AS p, exp(-rate / m) AS c FROM draws
  UNION ALL
  SELECT grp, rate, m, k + 1, p * (rate / m) / (k + 1), c + p * (rate / m) / (k + 1) FROM cdf WHERE k < {mix._STEPS}),
tables AS (SELECT grp, any_value(rate) AS rate, any_value(m) AS m, list(c ORDER BY k) AS cs FROM cdf GROUP BY grp),
counted AS (
  SELECT d.*, rate, list_sum(list_transform(range(1, m + 1), lambda j: len(list_filter(cs, lambda c: c <
           (('0x' || substr(md5('{MIX_SEED}|' || j || '|' || nm), 1, 13))::bigint + 0.5) / 4503599627370496.0)))) AS n
  FROM d JOIN tables USING (grp)),
copies AS (SELECT *, unnest(range(1, n::bigint + 1))::int AS mix_copy FROM counted)
SELECT {columns}, rate AS mix_rate, mix_copy, md5('{MIX_SEED}|order|' || nm || '|' || mix_copy) AS mix_key FROM copies"""


@query(mix_sql())
def op1_source_mixing(spark, sf_dir):
    mixed = mix.mix_sources(documents(spark, sf_dir), MIX_WEIGHTS, MIX_OTHER, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "source", "text", "mix_rate", "mix_copy", "mix_key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    return crc_remainder(F.col("doc_id"), modulus) == remainder


def with_prediction(scored: DataFrame, held: Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@query()
def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return with_prediction(toxicity.score_toxicity(docs, model), held_out(5, 0), 0.5)


@query()
def op3_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return with_prediction(quality.score_quality(docs, model), held_out(4, 2), 0.7)


@query()
def op4_language_model(spark, sf_dir):
    held = held_out(10, 0)
    scored = language_model.score_texts(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op5_token_counts(spark, sf_dir):
    return token_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op6_bpe_round_trip(spark, sf_dir):
    return bpe.bpe_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query()
def op8_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query()
def op9_secret_scan(spark, sf_dir):
    return secrets.span_digests(secrets.scan_secrets(documents(spark, sf_dir)))


@query()
def op10_winnowing(spark, sf_dir):
    return winnow.edit_fingerprints(documents(spark, sf_dir))


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT reach.a AS vec_id, coalesce(any_value(n_links), 0)::bigint AS n_links, min(reach.b) AS component_id, reach.a = min(reach.b) AS kept
FROM reach LEFT JOIN counted ON counted.a = reach.a GROUP BY reach.a""")
def op11_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


# the unsigned crc32 of a text of digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length({0}) + 1),
  lambda i: list_transform(range(0, 8), lambda j: (ascii(substr({0}, i, 1)) >> j::int)::bigint & 1)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC.format("doc_id::varchar")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS claim FROM documents),
e AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
tree AS (
  SELECT source, 0 AS lvl, pos, leaf AS digest, n FROM e
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (SELECT source, digest, lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, spos AS pos, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
-- runs of both trees under one numbering of levels: those of the upper tree follow a source's own
runs AS (
  SELECT source, t.lvl, t.pos // 3 AS run, list(t.digest ORDER BY t.pos) AS digests FROM tree t WHERE t.n > 1 GROUP BY source, t.lvl, t.pos // 3
  UNION ALL
  SELECT s.source, s.lvl + top.lvl, top.pos // 3, list(top.digest ORDER BY top.pos) FROM top, subroots s WHERE top.n > 1 GROUP BY s.source, s.lvl, top.lvl, top.pos // 3),
walk AS (
  SELECT e.doc_id, e.source, 0 AS lvl, CASE WHEN s.lvl = 0 THEN s.spos ELSE e.pos END AS pos, s.lvl AS own, s.spos, e.claim AS digest, '' AS siblings FROM e JOIN subroots s ON e.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, w.source, w.lvl + 1, CASE WHEN w.lvl + 1 = own THEN spos ELSE pos // 3 END, own, spos,
    sha256(array_to_string(list_concat(digests[1:(pos % 3)::int], [w.digest], digests[(pos % 3 + 2)::int:]), '')),
    siblings || array_to_string(list_concat(digests[1:(pos % 3)::int], digests[(pos % 3 + 2)::int:]), '')
  FROM walk w JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.lvl = r.lvl AND w.pos // 3 = r.run),
folded AS (SELECT doc_id, arg_max(digest, lvl) AS folded_root, arg_max(siblings, lvl) AS siblings FROM walk GROUP BY doc_id)
SELECT e.doc_id, e.leaf, s.digest AS subroot, r.digest AS root, sha256(f.siblings) AS proof_sha256, f.folded_root, f.folded_root = r.digest AS verified
FROM e JOIN subroots s ON e.source IS NOT DISTINCT FROM s.source JOIN folded f ON f.doc_id = e.doc_id, (SELECT digest FROM top WHERE n = 1) r""")
def op12_merkle_manifest(spark, sf_dir):
    tampered = crc_remainder(F.col("doc_id"), 2) == 0
    claimed = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle.manifest_proofs(documents(spark, sf_dir), claimed)
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", "verified")


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::bigint AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER w)::int AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
