"""Mixing sources to target weights.

Tokens are summed per source, targets come from water filling, each source gets a repetition
rate, and each document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with
probability equal to the fraction.

Defined results: null or wordless texts have size 0 and take nothing; null sources form one source,
ordered last; a null ``doc_id`` is seeded like an empty id; repeated rows are separate documents
with the same draw; an empty table gives an empty mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_small

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has BUDGET[0] / BUDGET[1] times the words of the input; no source is repeated over CAP times.
BUDGET, CAP = (3, 2), 2
#: Draws that compete for each source; the one whose words come nearest to the target is used.
SEEDS = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 2^32) from the document and the seed: four draws from each MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed // 4}")).cast("binary"))
    return F.conv(F.substring(digest, 8 * (seed % 4) + 1, 8), 16, 10).cast("double")


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """(source, size) rows to one row per source: source_size, target.

    Water filling in whole numbers: sources in order of cap/weight are at their cap for as long as
    the level that the rest would reach exceeds it. One row per source is all that the windows see.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    big = "decimal(38,0)"
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    unit = reduce(lambda a, b: a * b, weights, 1)
    per = per.withColumn("w", weight.cast(big)).withColumn("cap", (F.col("source_size") * cap).cast(big))
    order = Window.orderBy((F.col("cap") * unit / F.col("w")).cast(big), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = (
        per.withColumn("i", F.row_number().over(order))
        .withColumn("before", (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).cast(big))
        .withColumn("left", (budget[0] * F.sum("source_size").over(whole) - budget[1] * F.col("before")).cast(big))
        .withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(big))
        .withColumn("capped", (F.col("cap") * budget[1]) * F.col("open") <= F.col("left") * F.col("w"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("i", "left", "open"))).over(whole))
    )
    full = F.col("level").isNull() | (F.col("i") < F.col("level.i"))
    share = (F.col("w") * F.col("level.left")).cast("double") / (F.col("level.open") * budget[1]).cast("double")
    return per.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < (rate - F.floor(rate)) * 4294967296.0).cast("long")).cast("long")


def rates(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, source, size) rows to one row per source: source_size, target, rate, seed."""
    plan = cut(
        targets(sizes, weights, budget, cap).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        )
    )
    joined = with_plan(sizes, plan)
    taken = joined.groupBy("source").agg(
        *[F.sum(F.col("size") * _copies(F.col("rate"), draw(F.col("doc_id"), k))).alias(f"t{k}") for k in range(seeds)]
    )
    gap = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("gap"), F.lit(k).alias("seed")) for k in range(seeds)]
    best = taken.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source")))
    return cut(best.select("source", "source_size", "target", "rate", F.array_min(F.array(*gap))["seed"].alias("seed")))


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.withColumnRenamed("source", "plan_source")
    return join_small(docs, small, docs["source"].eqNullSafe(small["plan_source"])).drop("plan_source")


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``copies`` to documents that have doc_id and source, under the plan of :func:`rates`."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.floor(F.col("seed") / 4).cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 8 * (F.col("seed") % 4) + 1, F.lit(8)), 16, 10).cast("double")  # draw(doc_id, seed) for a seed from the plan
    return with_plan(docs, plan).withColumn("copies", _copies(F.col("rate"), u))


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, seeds: int = SEEDS) -> DataFrame:
    """The documents of the mix with their own columns, each repeated as often as it is taken."""
    plan = rates(sized(docs), weights, budget, cap, seeds)
    keyed = docs.select(F.col("doc_id"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_copies(keyed, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), computed once: three small columns in place of the text."""
    return cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))


def op7(docs: DataFrame) -> DataFrame:
    sizes = sized(docs)
    plan = rates(sizes)
    return with_copies(sizes, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def _sql_draw(seed: str) -> str:
    return f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || ({seed} // 4)::VARCHAR), (8 * ({seed} % 4) + 1)::INT, 8))::BIGINT"


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::HUGEINT AS w
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER o AS i,
         sum(2 * source_size) OVER (o ROWS UNBOUNDED PRECEDING) - 2 * source_size AS before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total
  FROM per WINDOW o AS (ORDER BY 2 * source_size * 6 // w, source NULLS LAST)
), levelled AS (
  SELECT *, min(CASE WHEN NOT cap * 2 * open <= (3 * total - 2 * before) * w THEN i END) OVER () AS first_open FROM ordered
), level AS (SELECT 3 * total - 2 * before AS rest, open FROM levelled WHERE i = first_open),
plan AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR i < first_open THEN cap::DOUBLE
              ELSE (w * (SELECT rest FROM level))::DOUBLE / ((SELECT open FROM level) * 2)::DOUBLE END AS target
  FROM levelled
), rated AS (
  SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size::DOUBLE ELSE 0.0 END AS rate
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), drawn AS (
  SELECT r.*, k.seed, floor(rate)::BIGINT + (({_sql_draw('k.seed')})::DOUBLE < (rate - floor(rate)) * 4294967296.0)::BIGINT AS copies
  FROM rated r, (SELECT unnest(range({SEEDS})) AS seed) k
), chosen AS (
  SELECT source, arg_min(seed, (gap, seed)) AS seed
  FROM (SELECT source, seed, abs(sum(size * copies)::DOUBLE - any_value(target)) AS gap FROM drawn GROUP BY source, seed) GROUP BY source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken, d.source, copies
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
"""
