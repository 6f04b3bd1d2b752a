"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; `run` writes every stage's result as Parquet
in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcurate.llm import decontaminate, language, minhash, packing, personal_data
from linkcurate.llm.common import apart, stored, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters (null and empty texts too), or with no language above one half, go.

    If no document has a label, no language can be told, and those with letters stay. Repeated rows stay or go each; all columns are
    kept as they are, whatever their names.
    """
    model = language.fit_text_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    rows, name, back = apart(docs)
    found = language.identify(rows, model, text=name["text"], declared=name["lang"], host=name["source"])
    return found.where("identified").select(*back)


def keep_one_of_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id (null ids last), then the first; rows without words all stay."""
    rows, name, back = apart(docs)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    key = name["doc_id"]
    found = minhash.near_duplicates(rows.select("row", F.col(name["text"]).alias("text")), key="row", numbered=True).select("row", "component_id")
    order = F.struct(F.col(key).isNull().alias("none"), key, "row")
    kept = rows.select("row", key).join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("row")), "row", "left_semi").select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in a passage of the benchmark; null and empty texts stay, repeated rows each."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; null texts stay null, repeated rows and other columns stay."""
    return personal_data.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null or empty text is one piece, the end id; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_identified), ("MinHash near-dedup", keep_one_of_duplicates), ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data), ("best-fit packing", pack_sequences),
]
#: SQL cannot express these stages; tests hold `run` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
