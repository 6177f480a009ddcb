"""Mixing sources to target weights by hash-threshold histograms.

Native: DataFrame functions only.

A document's size is its number of words.  Sources share a budget by weight;
no source gets more than ``cap`` times its size, and what it can't take is
reshared among the others.  A source that gets r times its size takes every
document floor(r) times, and once more those documents whose hash lies under a
threshold.  The threshold is found without sorting documents: sizes are summed
by source and the leading 12 bits of the hash, the bucket in which the budget
runs out is refined by the next 12 bits and then the last 8, and a document
needs only its own hash to know whether it is in.

Defined results: a null or blank text has size 0; a null source is a source of
its own, after all others; documents that share an id, or the 32 bits of its
hash, are taken together; a null id hashes as the empty text; a tie at the
threshold goes to the nearer total, the lower one where both are as near;
extra columns pass through ``mix`` and are ignored by ``assignments``; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS, CAP = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bits that each pass over the histogram resolves.
LEVELS = (12, 12, 8)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """32 bits of the id's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with a target: weights repeat over the sources in order; one row a source, so one window over all is small."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = (
        s.withColumn("place", F.row_number().over(filling))
        .withColumn("capped", F.sum(F.col("source_size") * cap).over(so_far) - F.col("source_size") * cap)
        .withColumn("open_weight", F.sum("weight").over(whole) - F.sum("weight").over(so_far) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("capped")) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("source_size") * cap, F.struct("place", "level"))).over(whole)
    s = s.withColumn("level", level.getField("level"))
    top = (F.col("source_size") * cap).cast("double")
    return s.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), top), top).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, hash), and per source: source_size, target, copies, threshold.

    A document is taken ``copies`` times, and once more if its hash is below the threshold.
    """
    base = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.coalesce(F.least(F.lit(cap), F.floor(F.try_divide("target", "source_size"))), F.lit(0)).cast("long")
    goals = materialize(
        targets(sources, weights, cap).withColumn("copies", rate)
        .withColumn("budget", F.when(F.col("copies") >= cap, 0.0).otherwise(F.col("target") - F.col("copies") * F.col("source_size")))
    )
    at = goals.select("source", "budget", F.lit(0).cast("long").alias("base"))
    rest, width = base.select("source", "size", "hash"), 1 << 32
    for bits in LEVELS:
        # ``base`` begins the cell in which the budget runs out; ``budget`` is what is left of it there.
        cells, width = width, width >> bits
        rest = (
            rest.join(at.select(F.col("source").alias("at"), "base", "budget"), F.col("source").eqNullSafe(F.col("at")))
            .where((F.col("hash") >= F.col("base")) & (F.col("hash") < F.col("base") + cells))
            .select("source", "size", "hash", "budget")
        )
        sums = rest.groupBy("source", (F.floor(F.col("hash") / width) * width).alias("base")).agg(F.sum("size").alias("here"), F.first("budget").alias("budget"))
        sums = sums.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("base")) - F.col("here"))
        at = materialize(sums.where("before <= budget and budget < before + here").select("source", "base", (F.col("budget") - F.col("before")).alias("budget"), "here"))
        rest = rest.select("source", "size", "hash")
    edge = at.select(F.col("source").alias("at"), (F.col("base") + (F.col("here") < 2 * F.col("budget")).cast("long")).alias("threshold"))
    goals = goals.join(edge, F.col("source").eqNullSafe(F.col("at")), "left")
    return base, goals.select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(1 << 32)).alias("threshold"))


def assignments(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    base, goals = plan(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), weights, cap)
    goals = materialize(goals).select(F.col("source").alias("at"), "source_size", "target", "copies", "threshold")
    joined = base.join(goals, F.col("source").eqNullSafe(F.col("at")))
    taken = (F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")) * F.col("size")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken."""
    _, goals = plan(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), weights, cap)
    goals = materialize(goals.select(F.struct(F.col("source").alias("at"), "copies", "threshold").alias("__mix_goal")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = docs.select(row.alias("__mix_row")).join(goals, F.col("__mix_row.source").cast("string").eqNullSafe(F.col("__mix_goal.at")))
    times = F.col("__mix_goal.copies") + (hashed(F.col("__mix_row.doc_id")) < F.col("__mix_goal.threshold")).cast("long")
    repeated = joined.select("__mix_row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("__mix_copy"))
    return repeated.select(*[F.col("__mix_row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: assignments of all documents."""
    from .common import table

    return assignments(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sources
), filling AS (
  SELECT *, row_number() OVER w AS place,
         sum(source_size * 3) OVER w - source_size * 3 AS capped,
         (SELECT sum(weight) FROM weighted) - sum(weight) OVER w + weight AS open_weight
  FROM weighted
  WINDOW w AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM filling
), chosen AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight < source_size * 3
), goals AS (
  SELECT source, source_size,
         coalesce(least((SELECT level FROM chosen) * weight, CAST(source_size * 3 AS DOUBLE)), CAST(source_size * 3 AS DOUBLE)) AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, CAST(floor(target / source_size) AS BIGINT)) END AS copies FROM goals
), budgets AS (
  SELECT *, CASE WHEN copies >= 3 THEN 0.0 ELSE target - copies * source_size END AS budget FROM rates
), grouped AS (
  SELECT source, hash, sum(size) AS here FROM base GROUP BY source, hash
), running AS (
  SELECT source, hash, here, sum(here) OVER (PARTITION BY source ORDER BY hash) - here AS before FROM grouped
), taken AS (
  SELECT r.source, r.hash FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WHERE 2 * r.before + r.here < 2 * b.budget
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST((b.copies + CASE WHEN t.hash IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken
FROM base d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN taken t ON t.source IS NOT DISTINCT FROM d.source AND t.hash = d.hash
"""
