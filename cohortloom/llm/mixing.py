"""Mixing sources to target weights by hash thresholds.

Every document has a draw, a hash of its id. A source that has to give ``target`` words gives ``floor(target / size)`` whole
rounds, and in one further round the documents whose draw lies below a threshold. The threshold comes from nested histograms
of words by (source, bucket of the draw): only the bucket at the boundary is cut again, until it holds a single draw. Nothing
is sorted and no source meets in one task, since every histogram is a partial sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.texts import n_words
from cohortloom.session import TooLarge, bounded_broadcast, cut_lineage, local_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
DRAW_BITS = 60
LEVEL_BITS = 12


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    rounds: int = 0
    below: int = 0  # documents with a smaller draw give one round more


def draw(doc_id: Column | str = "doc_id") -> Column:
    """60 bits of the md5 of the id as text (null: of the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[SourcePlan]:
    """Share ``share`` of all words by weight; a source stops at ``most`` times its size and the rest is shared again."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8")))  # UTF-8 order is code point order
    weight = {i: weights[i % len(weights)] for i in range(len(ordered))}
    total, full, left = sum(s for _, s in ordered), 0, sum(weight.values())
    out: dict[int, float] = {}
    # The source that fills up first has the least size per weight.
    for i in sorted(weight, key=lambda i: (ordered[i][1] / weight[i], i)):
        if weight[i] * (share * total - full) / left < most * ordered[i][1]:
            break
        out[i] = float(most * ordered[i][1])
        full += most * ordered[i][1]
        left -= weight[i]
    for i in weight:
        if i not in out:
            out[i] = weight[i] * (share * total - full) / left
    return [SourcePlan(s, n, out[i]) for i, (s, n) in enumerate(ordered)]


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, max_sources: int = 1_000_000) -> list[SourcePlan]:
    """Rounds and draw threshold per source from (source, size, draw); ``sizes`` is read once per level and should be stored.

    The number of sources is bounded by ``max_sources`` (an error beyond); no other limit exists.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).take(max_sources + 1)
    if len(rows) > max_sources:
        raise TooLarge(f"more than {max_sources} sources")
    plans = targets([(r["source"], int(r["size"] or 0)) for r in rows], weights, share, most)
    spark, open_, budget = sizes.sparkSession, {}, {}
    for i, p in enumerate(plans):
        p.rounds = int(p.target // p.size) if p.size else 0
        budget[i] = p.target - p.rounds * p.size if p.size else 0.0
        if budget[i] > 0:
            open_[i] = 0  # the prefix of the bucket at the boundary
    shift = DRAW_BITS
    while open_ and shift:
        shift -= LEVEL_BITS
        at = local_table(spark, [(plans[i].source, i, prefix, float(budget[i])) for i, prefix in open_.items()], "_s string, _i int, _prefix long, _budget double")
        inside = sizes.join(bounded_broadcast(at, len(plans)), F.col("source").eqNullSafe(F.col("_s")))
        inside = inside.where(F.shiftright("draw", shift + LEVEL_BITS) == F.col("_prefix"))
        histogram = (inside.groupBy("_i", "_budget", F.shiftright("draw", shift).alias("bucket"))
                     .agg(F.sum("size").alias("size"), F.min("draw").alias("low"), F.max("draw").alias("high")))
        # At most 4096 buckets of a source stand in a row; the first that goes beyond the budget is the boundary.
        histogram = histogram.withColumn("upto", F.sum("size").over(Window.partitionBy("_i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        fits = F.col("upto") <= F.col("_budget")
        boundary = histogram.groupBy("_i").agg(F.max(F.when(fits, F.col("upto"))).alias("spent"), F.max(F.when(fits, F.col("high"))).alias("last"),
                                               F.min(F.when(~fits, F.struct("bucket", "size", "low", "high"))).alias("next"))
        still = {}
        for r in boundary.toLocalIterator():  # a row per open source
            i, after = r["_i"], r["next"]
            if r["last"] is not None:
                plans[i].below = r["last"] + 1
                budget[i] -= int(r["spent"])
            if after is None:
                continue
            if after["low"] < after["high"]:
                still[i] = after["bucket"]
            elif int(after["size"]) - budget[i] <= budget[i]:  # one draw is left: take it if that comes nearer to the target
                plans[i].below = after["high"] + 1
        open_ = still
    return plans


def plan_table(spark, plans: list[SourcePlan]) -> DataFrame:
    return local_table(spark, [(p.source, p.size, p.target, p.rounds, p.below) for p in plans],
                       "_source string, source_size long, target double, rounds long, below long")


def copies() -> Column:
    return F.col("rounds") + F.when(F.col("draw") < F.col("below"), 1).otherwise(0)


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) of every document, stored in the checkpoint folder."""
    return cut_lineage(documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), draw().alias("draw")))


def mix_report(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    A null text counts 0 words; documents with a null source form a source of their own, last in order. Repeated rows and rows
    with a null id share a draw and are taken together. An empty table gives no rows. Other columns are ignored.
    """
    sizes = measured(documents)
    plans = plan_mix(sizes, **options)
    plans = bounded_broadcast(plan_table(sizes.sparkSession, plans), len(plans))
    return (sizes.join(plans, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed table itself: every document as many times as the mix takes it, with its own columns; rows as in ``mix_report``."""
    sizes = measured(documents)
    plans = plan_mix(sizes, **options)
    plans = bounded_broadcast(plan_table(sizes.sparkSession, plans), len(plans))
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), draw().alias("draw"), F.col("source").cast("string").alias("_from"))
    taken = own.join(plans, F.col("_from").eqNullSafe(F.col("_source"))).select("_row", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))))
    return taken.select("_row.*")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (pos % 3)::INT] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sources),
filled AS (SELECT *, coalesce(sum(2 * source_size) OVER earlier, 0)::DOUBLE AS before, sum(weight) OVER later AS weights FROM weighed
    WINDOW earlier AS (ORDER BY source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (ORDER BY source_size / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
capped AS (SELECT *, min(CASE WHEN weight * (budget - before) / weights < 2 * source_size THEN 0 ELSE 1 END)
    OVER (ORDER BY source_size / weight, pos) AS is_full FROM filled),
rest AS (SELECT coalesce(sum(2 * source_size) FILTER (WHERE is_full = 1), 0)::DOUBLE AS spent, sum(weight) FILTER (WHERE is_full = 0) AS weights FROM capped),
aimed AS (SELECT source, source_size, CASE WHEN is_full = 1 THEN (2 * source_size)::DOUBLE ELSE weight * (budget - spent) / r.weights END AS target
    FROM capped, rest r),
ranked AS (SELECT doc_id, size, draw, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS rounds,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY s.source, draw) AS same FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
cut AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target - rounds * source_size END AS extra FROM ranked)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN upto <= extra OR (upto - same < extra AND upto - extra <= extra - (upto - same))
    THEN 1 ELSE 0 END))::BIGINT AS taken FROM cut
"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Take words from all documents in the mix of source weights 5, 2, 1."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
