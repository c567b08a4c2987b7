"""Documents → token ids: quality rules, near duplicates, repeated passages, source weights, encoding."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permscan.llm import bpe, mixing, quality, simhash, suffix
from permscan.llm.queries import TOKENIZER, digests
from permscan.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator keeps, as they are. Null and blank texts go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the one with the smallest doc_id.

    Of rows that share this doc_id the least by text, language and source stays. A row without a doc_id stays only if
    nothing in its component has one. Rows in different components all stay, also where they repeat a doc_id or
    have none.
    """
    return simhash.least_of_components(docs, ["doc_id", "text", "lang", "source"], shingle=3, most=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller doc_id has too are taken out; no row goes.

    Null texts become empty, and ``n_chars`` is the length of what is left.
    """
    return suffix.without_repeats(docs, length=50).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, in whole copies.

    Documents are told apart by id, source and text, so rows without an id, or with one that others have too, are
    mixed with their own source. Equal rows each come by the share that the mix takes of all of them.
    """
    names = {c: f"_{n}" for n, c in enumerate(docs.columns)}
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\1")) for c in ("doc_id", "source", "text")]
    rows = docs.select(F.md5(F.concat_ws("\0", *told)).alias("key"), *[F.col(f"`{c}`").alias(at) for c, at in names.items()])
    queued = rows.select("key", F.col(names["text"]).alias("text"), F.col(names["source"]).alias("source"))
    mixed = mixing.mix(queued, id_col="key").withColumnRenamed("doc_id", "key")
    whole = mixed.groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = whole.select("key", F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias("copies"))
    joined = rows.join(copies.where("copies > 0"), "key")
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*[F.col(at).alias(c) for c, at in names.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` for every row; null texts have no ids."""
    path = public_tokenizers.path(TOKENIZER)
    return digests(bpe.encode_and_decode(docs, path), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

# EM, XXH64 and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
