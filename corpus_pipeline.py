"""A training-corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last
keep the columns of `documents`. Between stages the rows are written as Parquet in
the shared folder and read again, so a lost executor costs one stage at most.

Defined cases, for all stages: null doc_id, lang or source are values like any other;
null and empty texts go with the first stage, as none has a letter; texts of any length
are handled whole; rows that repeat are copies, of which the second stage keeps one;
an empty table stays empty, as does one without labels (no language is learnt, so all
go). An empty benchmark removes nothing. Columns beyond those of `documents` are handed
on, whatever their names, but for names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import decontaminate as decontamination
from scanlake.llm import jaccard, langid, mixing, token_store
from scanlake.llm.common import read
from scanlake.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; `lang` becomes the prediction.
    Learns from labelled documents; those without a letter go."""
    kept = langid.predict(docs).filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __row, 128 bits of (doc_id, text, source): a key that is never null. Null
    values count, as xxhash64() alone passes over them."""
    parts = [x for c in ("doc_id", "text", "source") for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn("__row", F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near copies (five words, 0.8) the document of the
    smallest doc_id, one without doc_id only where none has one. Rows that repeat a
    doc_id count as copies; rows without one are nodes by a hash of their text."""
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), F.coalesce("text", F.lit(""))))
    found = materialize(jaccard.components(docs.select(node.alias("doc_id"), "text"), n=5, percent=80))
    unnamed = docs.filter("doc_id is null").select(node.alias("__node")).distinct()
    # Components whose smallest node has no doc_id, though another has.
    member = found.join(unnamed, found.doc_id == F.col("__node"), "left")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("__node").isNotNull().alias("unnamed"), "doc_id")).alias("m"))
    first = first.select(F.col("component_id").alias("__c"), F.col("m.doc_id").alias("__first")).filter("__c <> __first")
    copies = found.join(first, found.component_id == F.col("__c"), "left").filter(F.col("doc_id") != F.coalesce("__first", "component_id"))
    kept = docs.withColumn("__node", node).join(copies.select(F.col("doc_id").alias("__id")).distinct(), F.col("__node") == F.col("__id"), "left_anti")
    kept = kept.withColumn("__text", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs, exactly or edited. Items that
    are null or wordless occur nowhere; rows are told apart by doc_id, text and source."""
    rows = keyed(docs)
    hit = decontamination.find(rows.select(F.col("__row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    hit = hit.select(F.col("doc_id").alias("__id")).distinct()
    return rows.join(hit, F.col("__row") == F.col("__id"), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as the mix takes them: a row for each pass over the stream of
    its source that takes the document. The one document of a source at which its target
    ends comes once more, cut after the last word taken (n_chars then counts what is
    left), so what a source gives is its target to within a word. Rows equal in doc_id,
    text and source share what they give among them. A source without words gives
    nothing."""
    rows = keyed(docs)
    pieces, sized = mixing.schedule(rows.select(F.col("__row").alias("doc_id"), "source", "text"))
    taken = pieces.groupBy("sid", "pos").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    each = sized.filter("size > 0").join(taken, ["sid", "pos"], "left").select(F.col("doc_id").alias("__id"), F.coalesce("taken", F.lit(0)).alias("taken"), "size")
    given = each.groupBy("__id").agg(F.count("*").alias("__n"), F.sum(F.expr("taken div size")).alias("__whole"), F.max(F.expr("taken % size")).alias("__cut"))
    given = materialize(given.filter("__whole > 0 or __cut > 0"))
    alike = rows.join(given, F.col("__row") == F.col("__id")).withColumn("__times", F.expr("__whole div __n"))
    rest = rows.join(given.filter("__cut > 0 or __whole % __n > 0"), F.col("__row") == F.col("__id")).dropDuplicates(["__row"])
    again = rest.withColumn("__times", F.expr("__whole % __n"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = rest.filter("__cut > 0").withColumn("text", F.array_join(F.slice(words, F.lit(1), F.col("__cut").cast("int")), "")).withColumn("__times", F.lit(1).cast("long"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = alike.unionByName(again).unionByName(cut).filter("__times > 0")
    return out.withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and return what it holds of each document, a row for each
    row of the mix."""
    return token_store.store(docs, remember=200_000, batch="2m")  # workers hold what earlier stages left


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language, components with trees, alignments and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else materialize(docs), sf_dir)
    return docs
