"""The registered queries of this folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from scorewell.catalog.common import Catalog, table
from scorewell.llm import (
    disclosure, kneser_ney, line_dedup, markov_secrets, mixture, packing, periodic, shared_search, simhash, spotsigs, style_tree, token_shards, wand,
)
from scorewell.llm.ship import ship
from scorewell.llm.spans import count_of, listed
from scorewell.session import fresh_path, materialize



class ShippedCatalog(Catalog):
    """Queries whose Python workers need this package."""

    def add(self, name, sql=None):
        register = super().add(name, sql)

        def shipped(fn):
            def run(spark, sf_dir):
                ship(spark)
                return fn(spark, sf_dir)

            register(run)
            return fn

        return shipped


catalog = ShippedCatalog()


@catalog.add("op1_simhash")
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@catalog.add("op2_token_shards")
def op2_token_shards(spark, sf_dir):
    return token_digests(spark, table(spark, sf_dir, "documents"))


def token_digests(spark, docs):
    """Write the documents' ids as shards, read every document back by its key, and sum up what was read."""
    folder = fresh_path(spark, "tokens")
    token_shards.write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_shards.read_documents(spark, folder, docs)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@catalog.add("op10_mixture")
def op10_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixture.words(F.col("text")).alias("words")), "words")
    found = mixture.draw(sized, F.col("words"))
    return found.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_shards")).alias("taken"),
    )


@catalog.add("op8_kneser_ney")
def op8_kneser_ney(spark, sf_dir):
    found = kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    perplexity = F.round(F.exp("kn_score"), 4).alias("perplexity")
    return found.select("doc_id", "lang", perplexity, F.round(F.exp("kn_limit"), 4).alias("limit"), F.col("kn_keep").alias("keep"))


@catalog.add("op9_bm25_wand")
def op9_bm25_wand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wand.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
    overlaps = [F.round(x, 6).alias(f"{x}_overlap") for x in ("question", "answer")]
    return leak.select("doc_id", "item_id", F.round("score", 6).alias("score"), *overlaps)


@catalog.add("op5_disclosure")
def op5_disclosure(spark, sf_dir):
    found = disclosure.personal_data(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in disclosure.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@catalog.add("op7_markov_secrets")
def op7_markov_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = markov_secrets.secrets(docs, markov_secrets.fit(docs))
    counts = [count_of("secret_base", k).alias(f"n_{k}") for k in markov_secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed("secret_base"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))


@catalog.add("op3_spotsigs")
def op3_spotsigs(spark, sf_dir):
    return spotsigs.edited_pairs(table(spark, sf_dir, "documents"))


@catalog.add("op4_style_tree")
def op4_style_tree(spark, sf_dir):
    found = style_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@catalog.add("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join("dropped", ","))


@catalog.add("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic.run_digests(periodic.with_runs(periodic.with_echoes(table(spark, sf_dir, "documents"))))


@catalog.add("op13_shared_search")
def op13_shared_search(spark, sf_dir):
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@catalog.add("op11_packing")
def op11_packing(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
