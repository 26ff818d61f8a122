"""From raw documents to token ids: five stages, each one operator of ``cairn.llm``.

Every stage takes (spark, docs, sf_dir); ``run`` writes what it returns to the
shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.bpe import encode_texts
from cairn.llm.common import read, staged
from cairn.llm.language import CHANCE, identify, learn_prototypes
from cairn.llm.mixing import mix_sources
from cairn.llm.near import near_components, text_key
from cairn.llm.quality_rules import quality_cascade

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of words that a worker of the last stage keeps: the stages before leave it less memory.
REMEMBERED = 1 << 26


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language, and give the predicted language to those without one.

    Dropped are texts without a letter (null and empty ones too), and texts
    whose cosine to every prototype is that of chance.  A known ``lang`` stays;
    a null one becomes the nearest prototype's.  With no language to learn
    from, only the letter is asked for and ``lang`` stays null.  Repeated rows
    are judged alike; columns besides those of documents fall.
    """
    prototypes = learn_prototypes(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    judged = identify(docs, prototypes, keep=COLUMNS)
    judged = judged.where((F.col("lang_pred") != "und") & (F.col("highest") >= CHANCE))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a quality rule rejects: null and empty texts, and those under 50 words, are among them.

    Repeated rows are judged alike; columns besides those of documents fall.
    """
    return quality_cascade(docs, keep=COLUMNS).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: the least id, of rows with that id the least text.

    Groups join texts whose shingles of five words have a Jaccard similarity
    of 0.8 or more, found by SimHash's positional bytes (``cairn.llm.near``)
    and compared by whole sets.  An id decides only within its group: rows of
    other groups stay, with the same id or without one.  A group without ids
    keeps its least text.  Null, empty and blank texts are one group; repeated
    rows leave one; columns besides those of documents fall.
    """
    roots = near_components(docs)
    rest = [F.asc_nulls_last("doc_id"), "text", "source", "lang", "n_chars"]
    # One row of each distinct text first: what follows has no repeated key.
    marked = docs.select(*COLUMNS, text_key("text").alias("_key"))
    marked = marked.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(*rest))).where("_place = 1")
    rooted = marked.join(roots, F.col("_key") == F.col("key"), "left")
    alone = rooted.where("root is null").select(COLUMNS)
    several = rooted.where("root is not null").withColumn("_place", F.row_number().over(Window.partitionBy("root").orderBy(*rest)))
    return alone.unionByName(several.where("_place = 1").select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: none to three times.

    Null and empty texts have no size and are taken or not like any other; a
    null source is a source; rows that agree in id and text have the same
    count each.  Columns besides those of documents fall.
    """
    taken = mix_sources(docs, keep=COLUMNS).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null and empty texts have no ids and decode to the empty text, which
    counts as intact.  Every row gives one row.
    """
    coded = encode_texts(docs, decoded=True, keep=COLUMNS, remembered=REMEMBERED)
    intact = F.coalesce(F.col("decoded_text") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", intact.alias("intact"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: SQL cannot state hyperdimensional profiles or SimHash components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
