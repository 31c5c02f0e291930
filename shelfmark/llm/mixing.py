"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in an order drawn by hash, lie on a line of words.  Slot ``j`` of the schedule is the point
``frac(j * golden ratio)``, looked up in the cumulative target weights: that gives its source.  The slots of a source
are ranked, each takes one of equally long blocks of the source's line, and blocks meet documents by rank.  All prefix
sums and ranks go by hash buckets, so a source that holds most rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import running_sum, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
_GOLDEN = 0.6180339887498949
_BUCKET_ROWS = 10_000
_BINS = 1024
_WORDS = "[^\\x20\\x09-\\x0D]+"


def words_in(text: str) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, place, target) of rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes.  A target stops at
    ``most`` times its source's size and what is over goes to the others by weight.  That is the level at which
    ``min(most * size, level * weight)`` adds up to the whole: sources in the order of ``size / weight`` are filled
    first, so one running sum over them finds it.  The table has one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    placed = sums.withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (
        placed.withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("_caps", F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
        .withColumn("_all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_weights", F.sum("weight").over(whole))
        # The level if this source and all later ones share what the earlier ones leave.
        .withColumn("_level", (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_used")))
    )
    reached = F.col("_level") * F.col("weight") <= F.col("cap")
    level = F.max(F.when(reached, F.col("_level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "n_docs", "place", target.alias("target"))


def _schedule(targets: DataFrame, n_slots: int) -> DataFrame:
    """(place, rank) of the slots: each source with words gets its share of the points, and one slot at least."""
    wanted = targets.filter("words > 0")
    upto = F.sum("words").over(Window.orderBy("place"))
    total = F.sum("words").over(Window.partitionBy())
    spans = wanted.select(
        "place", ((upto - F.col("words")) / total).alias("low"), (upto / total).alias("high")
    )
    bins = F.sequence(F.floor(F.col("low") * _BINS), F.least(F.floor(F.col("high") * _BINS), F.lit(_BINS - 1)))
    binned = spans.withColumn("bin", F.explode(bins))
    spark = targets.sparkSession
    point = F.pmod((F.col("id") + F.lit(0.5)) * F.lit(_GOLDEN), F.lit(1.0))
    points = spark.range(n_slots).withColumn("point", point).withColumn("bin", F.floor(F.col("point") * _BINS))
    within = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    slots = points.join(binned, "bin").filter(within).select("place", "id")
    # A source too small for any point still has its slot, after all others.
    extra = wanted.select("place", (F.lit(n_slots) + F.col("place")).alias("id"))
    drawn = slots.groupBy("place").agg(F.count(F.lit(1)).alias("_n"))
    missing = extra.join(drawn, "place", "left_anti")
    every = slots.unionByName(missing).withColumn("bucket", F.floor(F.col("id") / _BUCKET_ROWS)).withColumn("one", F.lit(1))
    return running_sum(every, ["place"], "bucket", [F.col("id")], "one", "rank").select("place", "rank", "id")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source): (documents, slices).

    ``documents`` has one row per document row: (doc_id, source, size, source_size, target, start), size in words and
    start its place on its source's line.  ``slices`` lists what the mix takes: (slot, doc_id, source, start, from,
    words), the words ``from`` and following of a document at the schedule's slot; a document taken again has more
    slices.  A source's slices add up to its target, rounded.  A null or empty text has size 0 and is never taken.
    A null source is a source of its own; repeated rows count each time; documents without an id are taken as well.
    The order depends on ids, sizes and sources alone, so reruns agree.
    """
    sized = stored(docs.select("doc_id", "source", words_in("text").alias("size")), "sizes")
    targets = source_targets(sized, weights, most).withColumn("words", F.round("target").cast("bigint"))
    targets = stored(targets, "targets")
    total = targets.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n_slots = max(1, -(-total // block))
    schedule = _schedule(targets, n_slots)

    facts = targets.select(F.col("source").alias("_source"), "source_size", "n_docs", "place", "target", "words")
    known = sized.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    draw = F.xxhash64(F.lit("mix"), "doc_id", "size")
    buckets = F.ceil(F.col("n_docs") / _BUCKET_ROWS)
    placed = known.withColumn("_draw", draw).withColumn("bucket", F.pmod("_draw", buckets))
    order = [F.col("_draw"), F.col("doc_id"), F.col("size")]
    lined = running_sum(placed, ["place"], "bucket", order, "size", "start").drop("_draw", "bucket", "n_docs")
    lined = stored(lined, "lines")

    # Copies of the line follow one another until the target is reached; slot r of m takes words [r, r + 1) * words / m.
    copy = F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size"))))
    m = schedule.groupBy("place").agg(F.count(F.lit(1)).alias("m"))
    reached = lined.filter((F.col("size") > 0) & (F.col("start") < F.col("words")))
    copies = reached.withColumn("_copy", copy).join(m, "place")
    copies = copies.withColumn("_at", F.col("start") + F.col("_copy") * F.col("source_size"))
    copies = copies.withColumn("_end", F.least(F.col("_at") + F.col("size"), F.col("words")))
    first = F.floor(F.col("_at").cast("double") * F.col("m") / F.col("words")) - 1
    last = F.floor((F.col("_end") - 1).cast("double") * F.col("m") / F.col("words")) + 1
    pieces = copies.withColumn(
        "rank", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("m") - 1)))
    )
    low = F.greatest(F.col("_at"), F.floor(F.col("rank") * F.col("words").cast("double") / F.col("m")))
    high = F.least(F.col("_end"), F.floor((F.col("rank") + 1) * F.col("words").cast("double") / F.col("m")))
    cut = pieces.withColumn("_low", low).withColumn("_words", high - low).filter("_words > 0")
    taken = cut.join(schedule, ["place", "rank"]).select(
        F.col("id").alias("slot"), "doc_id", "source", "start", (F.col("_low") - F.col("_at")).alias("from"),
        F.col("_words").cast("bigint").alias("words"),
    )
    return lined.select("doc_id", "source", "size", "source_size", "target", "place", "start"), taken


def taken_per_document(documents: DataFrame, taken: DataFrame) -> DataFrame:
    """``documents`` with ``taken``, the words the mix takes of each; a place on a source's line is one document row."""
    sums = taken.groupBy("source", "start", "doc_id").agg(F.sum("words").alias("taken"))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in ("source", "start", "doc_id")], "taken")
    same = (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    for key in ("source", "doc_id"):
        same &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = documents.join(sums, same, "left").drop("_source", "_start", "_doc_id")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
