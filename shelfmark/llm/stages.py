"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and gives the documents that stay, with the columns it was given; only the mix adds
some.  Columns beside doc_id, text, source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import contamination, mixing, near_duplicates, personal_data, quality
from shelfmark.llm.common import stored, table

MIXED = ("size", "source_size", "target", "taken")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of the documents has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; without a label to learn from, none is dropped.

    It learns from labelled documents that are not held out.  An empty or null text is scored like any other.
    """
    statistics = quality.text_statistics(F.col("text"))
    measured = stored(docs.select("doc_id", statistics.alias("statistics")), "statistics")
    model = quality.fit_quality(measured, table(spark, sf_dir, "labels"), ~quality.held_out_of(F.col("doc_id")))
    if model.weights is None:
        return docs
    (score,) = _free(docs, "_score")
    scored = docs.withColumn(score, quality.quality_score(statistics, model))
    return scored.filter(F.col(score) >= quality.LEAST).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 80 percent): the one with the smallest id.

    Where an id repeats with other texts, each text is in the group of its own words; if several texts of the smallest id
    are in one group, the one with the smallest MD5 stays.  Of rows that repeat an id and a text the least one by their
    columns in order stays.  Texts without words are near nothing and stay, as do documents without an id.
    """
    found = near_duplicates.near_duplicates(docs, percent=80).filter("doc_id IS NOT NULL")
    ident, print_, digest = _free(docs, "_i", "_d", "_digest")
    found = found.select(F.col("doc_id").alias(ident), F.lower(F.hex("digest")).alias(print_), "group_id")
    chosen = found.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct(ident, print_)).alias("k")).select("k.*")
    kept = stored(chosen.unionByName(found.filter("group_id IS NULL").select(ident, print_)).distinct(), "kept")
    same = [F.col("doc_id") == F.col(ident), F.col(digest) == F.col(print_)]
    keyed = docs.filter(F.col("doc_id").isNotNull()).withColumn(digest, _digest())
    left = keyed.join(kept, same, "left_semi")
    key = [F.col("doc_id").alias(ident), F.col(digest).alias(print_)]
    often = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(ident, print_)
    once = left.join(often, same, "left_anti").select(*docs.columns)
    least = F.min(F.struct(*docs.columns)).alias("row")
    repeated = left.join(often, same, "left_semi").groupBy(*key).agg(least).select("row.*")
    nameless = docs.filter(F.col("doc_id").isNull())
    return once.unionByName(repeated).unionByName(nameless).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain ten consecutive words of a benchmark item, or a whole shorter item.

    Proximity matches do not decide here: they report wordings that common phrases reach as well, and a clean document
    is not to go for them.
    """
    hits = contamination.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), slack=0).filter("n_hit > 0")
    ident, print_, digest = _free(docs, "_i", "_d", "_digest")
    dirty = hits.select(F.col("doc_id").alias(ident), F.lower(F.hex("digest")).alias(print_)).distinct()
    keyed = docs.withColumn(digest, _digest())
    same = [F.col("doc_id").eqNullSafe(F.col(ident)), F.col(digest) == F.col(print_)]
    return keyed.join(dirty, same, "left_anti").select(*docs.columns)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each personal span by its kind in brackets; ``n_chars``, where there, follows the text."""
    (spans,) = _free(docs, "_spans")
    clean = docs.withColumn(spans, personal_data.personal_spans(F.col("text")))
    clean = clean.withColumn("text", personal_data.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed)
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with size, source_size, target and the words taken, repeats counted.

    Documents of which it takes nothing go, among them empty ones.  Input columns of those four names are replaced.
    Rows alike in id, source and size get the shares of such rows in order, the largest share to the smallest MD5 of a
    text, so a rerun takes the same texts.
    """
    documents, taken = mixing.mix(docs)
    found = mixing.taken_per_document(documents, taken).filter("taken > 0")
    names = [c for c in docs.columns if c.lower() not in MIXED]
    size, number, digest, of_id, of_source, of_number = _free(docs, "_size", "_n", "_digest", "_id", "_source", "_m")
    alike = Window.partitionBy(of_id, of_source, "size").orderBy(F.col("taken").desc())
    chosen = found.select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), *MIXED)
    chosen = chosen.withColumn(of_number, F.row_number().over(alike))
    own = docs.select(*names, mixing.words_in("text").alias(size), _digest().alias(digest))
    own = own.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(digest)))
    same = (
        F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source))
        & (F.col(size) == F.col("size")) & (F.col(number) == F.col(of_number))
    )
    return own.join(chosen, same).select(*names, *MIXED)
