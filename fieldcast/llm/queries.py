"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import bpe, conversations, decontaminate, embedding, langid, license_scan, packing, pii, simhash, spelling, sql, substring, token_count, toxicity

#: Where the ranks of the byte-level BPE come from; a parameter of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces and scores of the unigram token counts.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text, modulo n: decides which rows a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: 4-word shingles, fingerprints linked at 4 differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9 or more."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.9)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license families of every document, by its paragraphs."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document: words hit by 13-word windows of the benchmark."""
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), ["doc_id"], window=13)
    said = decontaminate.verdict(found)
    return found.select("doc_id", *[c.alias(k) for k, c in said.items()], F.col("__spans").alias("removal_spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that every document is toxic, learnt from the labels outside a quarter that is held out."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), _remainder(4) != 2)
    return toxicity.scored(docs, index).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "evidence")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data, and how many values of each kind were replaced."""
    return pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, packed into rows of 2048."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(_remainder(5) != 0))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows outside a fifth that is held out."""
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs, _language_model(docs), ["doc_id"])
    return told.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"),
                       F.col("__score").alias("score"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document, and the score of the best cut."""
    pieces = token_count.read_pieces(public_tokenizers.path(PIECES))
    return token_count.token_counts(table(spark, sf_dir, "documents"), pieces)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every document, and of the bytes they decode to."""
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                       digest=True)


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that a smaller document has in a window of 13: counts and a digest of the rest."""
    found = substring.scan(table(spark, sf_dir, "documents"), ["doc_id"], window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "removal_spans")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a rule and repaired: its faults, the cost, the audit and a digest of the repaired text."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"), one_in=20)
    return conversations.digest(conversations.repaired(rows, present=F.col("present")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with its near words' count, its form and the root of its forms."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), min_length=7, min_count=2, one_in=31)
    return spelling.variants(words, ratio=10)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embedding": op2_embedding,
    "op3_license": op3_license,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_langid": op8_langid,
    "op9_token_count": op9_token_count,
    "op10_bpe": op10_bpe,
    "op11_substring": op11_substring,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = sql.ORACLE
