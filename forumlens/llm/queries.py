"""Queries that apply the operators to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlens.llm import (
    alignment, chat, decontamination, extraction, fingerprints, language, licences, linkgraph, packing, ranked_search, sharding,
    simhash, warc,
)
from forumlens.plans.registry import Query
from forumlens.sources.snapshots import scratch_directory
from forumlens.sources.tables import read_parquet

SHARDS = 16
TOKENIZER = "byte_bpe_50k.json"
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

_QUERIES: dict[str, Query] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a vocabulary lies; it has the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_rendezvous(spark: SparkSession, directory: str) -> DataFrame:
    """Every document in one of 16 shards, and where it would be with one more."""
    documents = read_parquet(spark, directory, "documents")
    text = F.col("text")
    placed = sharding.assign(
        documents,
        "doc_id",
        sharding.equal_weights(SHARDS),
        sharding.equal_weights(SHARDS + 1),
        {
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
            "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        },
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )


# A conversation that speaks in another template's control strings, added to the table by op9.
PLANTED_CONVERSATION = -1
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def _planted_conversation(spark: SparkSession) -> DataFrame:
    rows = spark.range(2).select(
        F.lit(PLANTED_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT).alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return rows


@query
def op9_prefix_targets(spark: SparkSession, directory: str) -> DataFrame:
    """Digests of all conversations, read back from their training examples."""
    turns = read_parquet(spark, directory, "conversations").unionByName(_planted_conversation(spark))
    examples = chat.expand(turns)
    trained = chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    # The last example of a conversation holds all its turns.
    found = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", trained.alias("text")))), lambda e: e["text"]), ""
        ).alias("trained"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    said = F.array_join(
        F.transform(chat.turns_of(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return found.select(
        "conv_id",
        F.size(chat.turns_of(F.col("whole"))).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query
def op10_licences(spark: SparkSession, directory: str) -> DataFrame:
    """Licences of all documents, by whole text and by whole line."""
    return licences.scan(read_parquet(spark, directory, "documents"), licences.known_licences(spark))


@query
def op7_simhash(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most four bits."""
    found = simhash.near_duplicates(read_parquet(spark, directory, "documents"))
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@query
def op5_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Hit words and items of all documents against all benchmark texts."""
    documents = read_parquet(spark, directory, "documents")
    found = decontamination.scan(documents, read_parquet(spark, directory, "benchmark"), ["doc_id"])
    return found.select(
        "source.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op8_language(spark: SparkSession, directory: str) -> DataFrame:
    """The language of all documents; the held-out quarter takes no part in training."""
    documents = read_parquet(spark, directory, "documents")
    profiles = language.train(documents.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(documents, profiles, ["doc_id"])
    doc_id = F.col("source.doc_id")
    return found.select(doc_id, language.held_out(doc_id).alias("held_out"), "lang_pred", "score")


@query
def op3_packing(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(read_parquet(spark, directory, "documents"), tokenizer_path(), ranks=tokenizer_path(RANKS))


@query
def op4_warc(spark: SparkSession, directory: str) -> DataFrame:
    """Write all pages into archives and read the archives back."""
    archives = scratch_directory(spark)
    warc.write_archives(read_parquet(spark, directory, "pages"), archives)
    found = warc.read_archives(spark, archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_extraction(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of all pages."""
    field = extraction.train(extraction.labelled_pages(spark))
    found = extraction.extract(read_parquet(spark, directory, "pages"), field, ["page_id", "url"])
    return found.select("source.page_id", "source.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(read_parquet(spark, directory, "documents"))


@query
def op11_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    documents = read_parquet(spark, directory, "documents")
    return ranked_search.search(documents, read_parquet(spark, directory, "benchmark"))


# Verdicts of op12 on hosts and paths.
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


@query
def op12_link_graph(spark: SparkSession, directory: str) -> DataFrame:
    """Verdicts on the URLs of all pages, by rules and by the link graph of hosts."""
    return linkgraph.filter_urls(read_parquet(spark, directory, "pages"), linkgraph.rules(spark, URL_RULES))


@query
def op13_alignment(spark: SparkSession, directory: str) -> DataFrame:
    """Two tokenizers' tokens of all documents, aligned, with the counts of their id pairs over all documents."""
    tokenizers = alignment.Tokenizers(*map(tokenizer_path, (TOKENIZER, RANKS, PIECES)))
    return alignment.align(read_parquet(spark, directory, "documents"), tokenizers)
