"""From documents to tokens: language, near copies, benchmark passages, secrets, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdetect.llm import decontamination, language, near_duplicates, pieces, secrets
from sparkdetect.llm.common import documents, stored

#: Below this share the language of a text is not taken as known.
LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; texts that are null or have no letter go."""
    model = language.fit(documents(spark, sf_dir).where(~language.held_out()))
    return language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least doc_id, nulls last, and of rows that share it the one with the least digest.

    Classes are told apart by their label, as unrelated texts may share a doc_id or have none. Rows with a null text are
    classes of their own and all stay.
    """
    # the choice is made on ids and digests; whole texts move once, to the rows that stay
    nodes = near_duplicates.labelled(docs.select("doc_id", "text"))
    first = nodes.groupBy("label").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("_first")).select("_first.low", "_first.node")
    key = lambda i, digest: F.concat_ws("|", F.coalesce(F.col(i).cast("string"), F.lit("null")), digest).alias("_key")  # noqa: E731  (one column, so that the join's shuffle also serves what follows)
    rows = docs.where("text IS NOT NULL").select(*docs.columns, key("doc_id", F.md5("text")))
    kept = rows.join(first.select(key("low", F.col("node"))), "_key").dropDuplicates(["_key"])
    return kept.select(docs.columns).union(docs.where("text IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; each text is judged alone, whatever rows share its doc_id."""
    found = decontamination.contaminated_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_id"), "digest").distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("digest")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    return secrets.scan(docs, redact=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and whether they decode to the text (a text that holds the mark for a space does not)."""
    model = pieces.read_model(pieces.default_model())
    rows = pieces.encode(docs.select("doc_id", "text"), model, decoded="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language", keep_known_language),
    ("near copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", to_pieces),
]

#: SQL cannot express the language model, the hashes of the signatures or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
