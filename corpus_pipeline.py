"""A training corpus from documents: toxic ones out, one of each near-duplicate group, personal data masked, sources mixed to
their weights, and the mix encoded. Each stage's result is written as Parquet and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, ngram_join, pii, spm, toxicity
from quarry.llm.common import cut, only_result, pick, release, table
from quarry.llm.queries import quality_weights, vocabulary


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores in front until no column of docs bears it."""
    out = []
    for n in names:
        while n.lower() in {c.lower() for c in docs.columns}:
            n = "_" + n
        out.append(n)
    return tuple(out)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic, as they are. Null and empty texts score as the bias; rows of
    one text share their fate; an empty table stays empty; other columns pass through, whatever their names."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    names = unused(docs, "score", "predicted")
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard 0.8 or more over five-word shingles: the one of the smallest doc_id, null being the
    largest, and of the smallest hash of the text among equals. Documents without words are nobody's copies and stay."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows. Null texts stay null, with n_chars null; all rows stay; an
    empty table stays empty; other columns pass through, whatever their names."""
    out = pii.find(docs, pii.train(docs), redacted="text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it, by row: rows that share a doc_id, or have none, are mixed each for themselves.
    Documents without words, null texts among them, are in no mix; null sources are one; an empty table stays empty; other columns pass
    through, whatever their names."""
    held = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")), compression="zstd")
    rows = held.select("rid", *(F.col("row")[c].alias(c) for c in ("doc_id", "text", "source")))
    times = cut(mixing.mix(rows, quality_weights(spark, sf_dir), keep=("rid",)).where("times > 0").select("rid", "times"))
    most = times.agg(F.coalesce(F.max("times"), F.lit(0))).first()[0]
    out = held.limit(0)
    for i in range(1, most + 1):
        out = out.unionByName(pick(held, times.where(F.col("times") >= i)))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def encode_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether decoding them gives its text back. Null texts have no ids; all rows stay,
    repeated ones with equal ids; an empty table stays empty; other columns are not read."""
    out = spm.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "n_bytes", "n_tokens", "ids_crc32", "round_trip", "token_ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_mix),
]

#: The stages learn models and match texts by shingles: no SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Null texts pass as empty, are no one's copy and are dropped by the mix; an empty table
    gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with only_result(spark):
            docs = cut(stage(spark, before, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
