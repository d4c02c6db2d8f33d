"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Buckets of that key, by source, are ranges of
equal width, so they hold about equal shares of any source, a hot one included:
sizes are summed by bucket, bucket sums are accumulated by source, and a window
inside each bucket finishes the prefix sum. No task ever sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents that a bucket should hold.
BUCKET_ROWS = 2_000


def word_count(text: F.Column) -> F.Column:
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, target.

    sizes: source, source_size. Sources sorted by code point (null last) weigh
    ``weights`` in turn. They share ``share`` of the total; a target stops at ``most``
    times its source's size and the excess is shared anew by weight. That fixed point
    is target = min(cap, level * weight) with one level for all, found by sorting
    the sources by cap / weight: the level is the first at which what the sources before
    it can't take, shared over the rest, doesn't reach the next cap.
    """
    # One row per source: a small table, so one partition for its order is fine.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    )
    # Where the level stays below a source's ratio, that source and all after it are not capped.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return t.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken; epochs, rest, place, text_hash.

    taken: words of the document that the mix holds. A source gets its whole epochs
    first; the rest of its budget goes to documents in key order, and the one in which
    the budget ends is cut there, so each source's sum is the floor of its target.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null id
    is kept. Rows with equal id, text and source are told apart by nothing: they are counted first, however
    many, and stand one after the other; the multiset of rows returned is the same on every run. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    text_hash = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_hash))
    sized = common.materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), text_hash.alias("text_hash")),
        "mix-sizes",
    )
    # Rows that nothing tells apart are one row with their number from here on.
    same = ["id", "source", "size", "key", "text_hash"]
    sized = common.materialize(sized.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "mix-rows").withColumn("weight", F.col("size") * F.col("copies"))
    # Bits of the key that name a bucket: from the number of rows, which the written table's footers tell.
    bits = min(48, max(0, (sized.count() // BUCKET_ROWS).bit_length()))
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), 48 - bits))
    # Two levels of prefix sums, so that no task holds all buckets of a source.
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("weight").alias("bucket_size")).withColumn("shelf", F.shiftright("bucket", bits // 2))
    by_shelf = by_bucket.groupBy("source", "shelf").agg(F.sum("bucket_size").alias("shelf_size"))
    sizes = by_shelf.groupBy("source").agg(F.sum("shelf_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_s")
    earlier = Window.partitionBy("source").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelves = (
        by_shelf.withColumn("under", F.coalesce(F.sum("shelf_size").over(earlier), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("shelf").alias("_f"), "under", "source_size", "target")
    )
    beside = Window.partitionBy("source", "shelf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        by_bucket.withColumn("beside", F.coalesce(F.sum("bucket_size").over(beside), F.lit(0)))
        .join(shelves, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shelf") == F.col("_f")))
        .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("under") + F.col("beside")).alias("base"), "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0))).join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).withColumn("inside", F.col("inside") + F.col("copy") * F.col("size"))
    goal = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inside")))
    return (
        placed.withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", rest.cast("long"))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
            F.col("epochs"),
            "rest",
            (F.col("base") + F.col("inside")).alias("place"),
            "text_hash",
        )
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix holds them, all columns kept: a row for each time a document is taken.

    Documents stay whole: the one in which its source's budget ends is taken if half of it or more is
    within; a document without words goes with the place it stands at. Rows with equal id and text
    are taken as one document that is there that many times; where they differ in other columns, the row of the smallest hash of its columns stands for them.
    Null ids, texts and sources as in ``mix_sources``. Other columns, whatever their names, go along. An empty table gives no rows.
    """
    taken = mix_sources(docs.select("doc_id", "text", "source"), **how)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs") + F.when(F.col("size") > 0, (2 * part >= F.col("size")).cast("long")).otherwise((F.col("place") < F.col("rest")).cast("long"))
    counts = taken.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).agg(F.sum(times).alias("times")).where("times > 0")
    whole = common.one_of_each(docs, [F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))])
    joined = whole.join(counts, F.col("key.c0").eqNullSafe(F.col("i")) & (F.col("key.c1") == F.col("h")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || doc_id::VARCHAR || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT] AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
