"""The registered corpus queries. Each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lintel.llm import bpe_lexicon, collocations, hnsw, mixing, ngram_join, packing, pii_crf, quality_cnn, quality_rules, repair, sharding, suffix_dedup, toxicity_mil
from lintel.llm import sql
from lintel.llm.common import read

QUERIES = {}
SQL = {"op1_ngram_jaccard": sql.NEAR_DUPLICATES, "op2_quality_rules": sql.QUALITY_RULES, "op3_mix_sources": sql.MIX_SOURCES, "op5_suffix_dedup": sql.SUFFIX_DEDUP, "op11_era_collocations": sql.COLLOCATIONS}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_quality_rules(spark, sf_dir):
    out = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query
def op3_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_pack_hilbert(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query
def op6_pii(spark, sf_dir):
    return pii_crf.find_pii(read(spark, sf_dir, "documents"))


def _fold(of: int):
    """The rest of crc32(doc_id as text) by ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def _held_out(scored, of: int, rest: int):
    held = F.coalesce(_fold(of) == rest, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_quality_cnn(spark, sf_dir):
    return _held_out(quality_cnn.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), _fold(4) != 2), 4, 2)


@query
def op8_shard_shuffle(spark, sf_dir):
    out = sharding.shuffle_shards(read(spark, sf_dir, "documents"), 24)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_toxicity_mil(spark, sf_dir):
    return _held_out(toxicity_mil.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), _fold(3) != 1), 3, 1)


@query
def op10_hnsw(spark, sf_dir):
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


@query
def op11_era_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query
def op12_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations")
    return repair.report(repair.damage(conversations), conversations)


@query
def op13_bpe_lexicon(spark, sf_dir):
    out = bpe_lexicon.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
