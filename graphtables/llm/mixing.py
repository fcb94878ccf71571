"""Mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. Each document gets the exponential key -ln(u) / quality weight, u hashed from its id; within
its source documents are taken in the order of their keys, until the prefix sum of their sizes meets the source's budget. A
source's complete epochs (every document once each) come before this fractional selection.

Scale: only (id, source, size, key) travel, never texts. A source is cut into ranges of the key; the prefix sums of the ranges come
from one small aggregate, and documents are ordered inside a range only, so a source of any size divides over many tasks. DataFrame
operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, counted, cut

WEIGHTS = (1, 2, 3)
#: Times a source's size that its target may be at most.
MOST_EPOCHS = 3
RANGES = 4096


def size_in_words(text: str = "text") -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """A plain weight in (0, 1]: prose has words of four to eight characters."""
    mean = F.length(text) / F.greatest(F.col(size), F.lit(1))
    return F.coalesce(1.0 / (1.0 + F.abs(mean - 6.0) / 3.0), F.lit(0.05))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with target: sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes;
    none gets above ``most`` times its size, what is over goes to the others by weight until none is above.

    The shares are level * weight for those below their cap; the level follows from the sources sorted by cap / weight."""
    # a source's cap binds exactly if level * weight exceeds it, and the level is the one at which all targets sum to the total
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", turn.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source whose cap isn't reached fixes the level
    levels = ranked.withColumn("at", level).withColumn("level", F.min(F.when(F.col("at") <= F.col("ratio"), F.struct("ratio", "at"))).over(every)["at"])
    return levels.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, boundary: str = "split", ranges: int = RANGES) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, taken (words the mix takes of it), copies.

    ``boundary``: ``split`` takes of each source's last document just the words that are left of the budget; ``whole`` takes it
    whole if that comes nearer. Null texts have size 0 and are never taken; the null source is a source; repeated rows count each;
    with no words at all every target is 0. Ties of keys are broken by id and size."""
    measured = docs.select("doc_id", "source", (size if size is not None else size_in_words()).alias("size"), F.length("text").alias("_n"), "text")
    measured = measured.select("doc_id", "source", "size", (quality if quality is not None else quality_weight()).alias("quality"), "_n")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_n"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = measured.select("doc_id", "source", "size", (-F.log(u) / F.col("quality")).alias("key"))
    keyed = cut(keyed.withColumn("range", F.floor((1.0 - F.exp(-F.col("key") / 2.0)) * ranges).cast("int")))

    summed = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    wanted = targets(summed.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    behind = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = summed.withColumn("behind", F.coalesce(F.sum("range_size").over(behind), F.lit(0))).join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    p = plan.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "behind", "source_size", "target", "epochs", "left")
    met = keyed.join(p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).drop("_source", "_range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("behind") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))
    if boundary == "whole":
        more = F.when((F.col("room") > 0) & (2 * F.col("room") >= F.col("size")), F.col("size")).otherwise(0)
    taken = met.withColumn("room", room).withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", copies.alias("copies"))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, whole, each as often as it is taken. All columns stay, whatever their names.

    Rows that share an id (or have none) are taken as often as the most taken of them; rows without words are never taken; an empty table
    stays empty."""
    chosen = mix(docs, boundary="whole", **options)
    names = {x.lower() for x in docs.columns}
    copies, key, copy = (next(y for i in range(99) if (y := f"_{x}{i}").lower() not in names) for x in ("copies", "doc_id", "copy"))
    counts = chosen.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    counts, n = counted(counts, "mixing")
    if n <= BROADCAST_IDS:
        counts = F.broadcast(counts)
    met = docs.join(counts, F.col("doc_id").eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return met.select(*[F.col(f"`{x}`") for x in docs.columns])
