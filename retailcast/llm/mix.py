"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in the order of their names (null last) have the weights ``WEIGHTS`` in turn and share
``SHARE`` of all words; a target stops at ``REPEAT`` times its source's words, and what is left over is shared
again by weight. Targets are laid out in slots of ``BLOCK`` words. Slot i takes the van der Corput
point of i (its bits mirrored) through the cumulative slot counts to a source; slots are ranked
within their source. A source's documents, shuffled by a seeded hash, anew for each repeat, form a stream
cut into blocks of equal words. The slot of rank r joins block r. Points fall within a few slots of
the counts wanted: ranks beyond a target are dropped, missing ones follow at the end. So a source
gives its whole target, rounded down, and no document more than REPEAT times its words.

Ranks and stream positions are running sums over hash buckets and slot ranges first, then within
each, so a source of any size is not one task. Positions depend only on ids, texts and the seed:
reruns agree.

Defined results: null texts have no words and are never taken; null sources are one source; each
row gives a row, also if ids are null or repeated. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import staged

# Fixed values of the mixture.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 64
SEED = 20240601
#: Documents to a bucket of a stream; slots to a range; and bins over the cumulative slot counts.
BUCKET_ROWS, RANGE_SLOTS, BINS = 20_000, 1 << 16, 4_096
_BITS = 62


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source_no, source, source_size, target): a row for each source of ``sized`` (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))))
    named = (sums.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
             .withColumn("cap", F.col("source_size").cast("double") * repeat))
    # In the order in which they fill up, the level at which the rest would share what is left.
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(all_) * F.lit(float(share)) - (F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    open_ = F.sum("weight").over(all_) - (F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    levels = named.withColumns({"level": rest / open_, "k": F.row_number().over(by)})
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("k", "level"))
    level = F.min(fits).over(all_)["level"]
    return levels.withColumn("at", level).select(
        "source_no", "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mirrored(i: Column) -> Column:
    """Van der Corput point of i in base 2."""
    bits = F.reverse(F.lpad(F.bin(i), _BITS, "0"))
    return F.conv(bits, 2, 10).cast("double") / F.lit(float(1 << _BITS))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, source_no, rank, length): the slots in order, with the words that each takes."""
    spark = targets.sparkSession
    wanted = targets.select("source_no", F.floor("target").cast("long").alias("goal")).withColumn("slots", F.ceil(F.col("goal") / block).cast("long"))
    upto = F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    wanted = wanted.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots"))
    n = wanted.agg(F.max("hi")).first()[0] or 0
    width = max(1, -(-n // BINS))
    spread = wanted.where("slots > 0").withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    points = (spark.range(n).select(F.col("id").alias("place"), F.least(F.floor(mirrored(F.col("id")) * n).cast("long"), F.lit(max(n - 1, 0))).alias("x"))
              .withColumn("bin", F.expr(f"x div {width}")).withColumn("range", F.expr(f"place div {RANGE_SLOTS}")))
    slots = points.join(spread, "bin").where("x >= lo and x < hi").select("place", "range", "source_no")
    counts = slots.groupBy("source_no", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("range")) - F.col("n"))
    ranked = (slots.withColumn("at", F.row_number().over(Window.partitionBy("source_no", "range").orderBy("place")) - 1)
              .join(before, ["source_no", "range"]).select("place", "source_no", (F.col("before") + F.col("at")).alias("rank")))
    given = counts.groupBy("source_no").agg(F.sum("n").alias("given"))
    late = (wanted.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
            .select((F.lit(n) + F.col("lo")).alias("place"), "source_no", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
            .select((F.col("place") + F.col("rank")).alias("place"), "source_no", "rank"))
    return (ranked.unionByName(late).join(wanted.select("source_no", "goal", "slots"), "source_no").where("rank < slots")
            .select("place", "source_no", "rank", F.least(F.lit(block), F.col("goal") - F.col("rank") * block).cast("long").alias("length")))


def stream_blocks(docs: DataFrame, targets: DataFrame, block: int = BLOCK, repeat: int = REPEAT, seed: int = SEED) -> DataFrame:
    """(source_no, rank, row, begin, length): the pieces of documents (from word ``begin`` on) in the blocks."""
    n = docs.count()
    copies = (docs.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
              .withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash"))
              .withColumn("bucket", F.pmod(F.col("h"), F.lit(max(1, -(-n // BUCKET_ROWS))))))
    group = ["source_no", "epoch", "bucket"]
    sums = copies.groupBy(*group).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source_no", "epoch").orderBy("bucket")) - F.col("words"))
    inside = Window.partitionBy(*group).orderBy("h", "doc_id", "size", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (copies.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(sums.drop("words"), group)
              .join(targets.select("source_no", "source_size", F.floor("target").cast("long").alias("goal")), "source_no")
              .withColumn("from", F.col("epoch") * F.col("source_size") + F.col("before") + F.col("at"))
              .withColumn("to", F.least(F.col("from") + F.col("size"), "goal")).where("`from` < `to`"))
    cut = placed.withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    first, last = F.greatest(F.col("from"), F.col("rank") * block), F.least(F.col("to"), (F.col("rank") + 1) * block)
    return cut.select("source_no", "rank", "row", (first - F.col("from")).alias("begin"), (last - first).alias("length"))


def _known(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with a number, sizes and their source's target; and the targets."""
    sized = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"),
                               F.xxhash64("text").alias("text_hash")), "sizes")
    targets = staged(source_targets(sized), "targets")
    s, t = sized.alias("s"), targets.select("source_no", F.col("source").alias("name"), "source_size", "target").alias("t")
    return s.join(t, F.col("s.source").eqNullSafe(F.col("t.name"))).drop("name"), targets


def _pieces(known: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """(row, place, begin, length): what each slot of the schedule takes of which row."""
    pieces = stream_blocks(known.select("row", "doc_id", "text_hash", "size", "source_no"), targets, block)
    return pieces.join(schedule(targets, block).select("source_no", "rank", "place"), ["source_no", "rank"]).drop("source_no", "rank")


def mixed_stream(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture of ``docs`` (doc_id, source, text): (place, doc_id, text_hash, source, begin, length), the
    words from ``begin`` on that the slot ``place`` takes. Ordered by place, each prefix follows the targets;
    a slot of ``block`` words can hold pieces of several documents."""
    known, targets = _known(docs)
    return (_pieces(known, targets, block).join(known.select("row", "doc_id", "text_hash", "source"), "row")
            .select("place", "doc_id", "text_hash", "source", "begin", "length"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, text_hash, size, source_size, target, taken
    (words the mix takes, repeats counted), first_place (the first slot that takes of it, null if none)."""
    known, targets = _known(docs)
    taken = _pieces(known, targets, block).groupBy("row").agg(F.sum("length").alias("taken"), F.min("place").alias("first_place"))
    return known.join(taken, "row", "left").select(
        "doc_id", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_place")
