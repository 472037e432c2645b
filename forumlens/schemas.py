"""Explicit schemas and fixed values of the data model."""

from pyspark.sql import types as T

# Limits and defaults every run shares unless a caller overrides them.
EXPECTED_DIM = 1536
MAX_ABS_VALUE = 100.0
MAX_TOKENS = 8191
EMBED_BATCH_ROWS = 2048
DEFAULT_RESULTS = 10
DEFAULT_COSINE_RESULTS = 5
TITLE_BOOST = 3.0
RECENCY_SCALE_SECONDS = 864000
RECENCY_DECAY = 0.5
BM25_K1 = 1.2
BM25_B = 0.75

# Keys of the JSON result document.
VECTOR_RESULTS_KEY = "faiss_results"
KEYWORD_RESULTS_KEY = "elasticsearch_results"
COMBINED_RESULTS_KEY = "combined_results"

# Raw tables the forum views read.
RAW_TABLES = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
}

POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("post_date", T.LongType()),
    ]
)

THREADS = T.StructType(
    [
        T.StructField("thread_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("last_post_date", T.LongType()),
        T.StructField("node", T.LongType()),
    ]
)

# vec_id is the row key of a vector: unique, and the tie-break of every ranking.
EMBEDDING_STORE = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("post_id", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_length", T.IntegerType()),
        T.StructField("is_truncated", T.BooleanType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)

# Columns an upsert refreshes on a key that is already stored; the others keep their old value.
UPSERT_COLUMNS = ("embedding", "embedding_length", "is_truncated")

VECTOR_EXPORT = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_length", T.IntegerType()),
    ]
)

TEXT_QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("max_results", T.IntegerType()),
    ]
)

# One result of either kind: post hits fill the first five fields after type, thread hits the last two.
DETAIL = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("post_id", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("post_date", T.LongType()),
        T.StructField("thread_title", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("last_post_date", T.LongType()),
    ]
)

VECTOR_RESPONSE = T.StructType([T.StructField(VECTOR_RESULTS_KEY, T.ArrayType(DETAIL))])
