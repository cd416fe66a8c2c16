"""A corpus from raw documents to token ids: five stages, each written and read again.

``STAGES`` are (name, function) with ``function(spark, docs, sf_dir) -> DataFrame``. All but
the last return the columns of documents. ``run`` applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from loglens.llm.common import bounded_batches, small_side, stored, table
from loglens.llm.skew import left_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose main language holds less of its letters than this is rejected.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of which no language holds half."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.filter(~language_id.is_held_out("doc_id")))
    got = language_id.labelled(docs, model, keep=COLUMNS)
    return got.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 5 documents or more stay in the last one; a document that lost all its text goes."""
    got = line_dedup.deduplicated(docs.select(*COLUMNS))
    left = got.filter("n_dropped = 0 OR length(trim(both ' \\t\\n\\r' from text)) > 0")
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint"))
                           .otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one of the smallest id stays (rows without an id come last).

    What links are texts, so a row is known by the hash of its id and text: rows that share an id or have none are
    each judged by their own text, and of rows equal in both one stays.
    """
    docs = docs.select(*COLUMNS)
    known = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", known.alias("row"))
    groups = stored(jaccard_join.near_duplicate_groups(keyed.select("row", "text"), doc="row"))
    ids = groups.select("row", F.col("component_id").alias("component")).join(keyed.select("row", "doc_id").distinct(), "row").distinct()
    ids = stored(ids)
    stays = stored(ids.groupBy("component").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
                                                F.count("*").alias("n")).filter("n > 1"))
    gone = left_join(ids, stays, "component", "n", ids.count(), "row").filter("row <> first").select("row")
    gone = stored(gone.distinct())
    again = stored(groups.groupBy("row").count().filter("count > 1").select("row"))
    kept = docs.withColumn("row", known).join(small_side(gone, 16), "row", "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    once = (kept.join(small_side(again, 16), "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("first"))
            .select("first.*"))
    return kept.join(small_side(again, 16), "row", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; ``lossless``: decoding them gives the text again."""
    import public_tokenizers
    vocab = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encoded(docs.select(*COLUMNS), vocab, keep=COLUMNS)
    got = bpe.decoded(ids, vocab, keep=[*COLUMNS, "n_tokens", "ids"])
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return got.select(*COLUMNS, "n_tokens", "ids", same.alias("lossless"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: Language ID and BPE have no SQL form; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
