"""Equivalent SQL for the checked queries, written for DuckDB over the raw tables."""

from __future__ import annotations

from forumlens.functions.text import TOKEN_PATTERN, WORD_PATTERN
from forumlens.plans.registry import DIM, FUSED_LIMITS, NOW, RECENCY_ORIGIN, TRUNCATE_AT
from forumlens.sources.tables import LIMITS, PLACES

def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD_PATTERN}')"


def _digest(vector: str) -> str:
    return (
        f"round(list_sum(list_transform(list_zip({vector}::DOUBLE[], range(1, len({vector}) + 1)), "
        "lambda p: p[1] * p[2])), 6)"
    )


def _vectors_of(source: str, key: str, column: str) -> str:
    """Hashed vectors of a text column, as ``key, embedding``."""
    return f"""
    SELECT k AS {key}, list((coalesce(s, 0) / n)::FLOAT ORDER BY position) AS embedding
    FROM (SELECT k, n, unnest(range({DIM})) AS position FROM
           (SELECT k, sqrt(sum(s * s)::DOUBLE) AS n FROM {source}_sums GROUP BY k HAVING sum(s * s) > 0))
    LEFT JOIN (SELECT k, bucket AS position, s FROM {source}_sums) USING (k, position)
    GROUP BY k"""


def _sums_of(source: str, key: str, column: str) -> str:
    return f"""
    SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS bucket,
           sum(CASE WHEN instr('02468ace', substr(md5(w), 9, 1)) > 0 THEN 1 ELSE -1 END)::BIGINT AS s
    FROM (SELECT {key} AS k, unnest({_words(column)}) AS w FROM {source}) GROUP BY ALL"""


def _nearest(queries: str, corpus: str, k: int, metric: str) -> str:
    if metric == "l2":
        score = (
            "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), "
            "lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        )
        order, name = "round(score, 9)", "distance"
    else:
        score = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
        order, name = "round(score, 9) DESC", "similarity"
    return f"""
    SELECT query_id, rank, vec_id, post_id, thread_id, score AS {name} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id)::INT AS rank FROM (
        SELECT q.query_id, c.vec_id, c.post_id, c.thread_id, {score} AS score FROM {queries} q, {corpus} c))
    WHERE rank <= {k}"""


def _details(hits: str) -> str:
    return f"""
    SELECT query_id, rank, 'post' AS type, h.post_id, p.thread_id, message, post_date, t.title AS thread_title,
           NULL AS title, NULL::BIGINT AS last_post_date
    FROM {hits} h JOIN posts p ON h.post_id = p.post_id JOIN threads t ON p.thread_id = t.thread_id
    WHERE h.post_id IS NOT NULL
    UNION ALL
    SELECT query_id, rank, 'thread', NULL, h.thread_id, NULL, NULL, NULL, t.title, t.last_post_date
    FROM {hits} h JOIN threads t ON h.thread_id = t.thread_id WHERE h.post_id IS NULL"""


def _bm25(count: str, length: str, average: str, idf: str) -> str:
    return (
        f"CASE WHEN {count} > 0 THEN {idf} * ({count} * 2.2e0) / "
        f"({count} + 1.2e0 * (0.25e0 + 0.75e0 * {length} / {average})) ELSE 0e0 END"
    )


def _idf(matching: str) -> str:
    return f"ln(1e0 + (posts - {matching} + 0.5e0) / ({matching} + 0.5e0))"


_WORD_SCORE = "3e0 * {} + {}".format(
    _bm25("title_count", "title_length", "average_title", _idf("title_posts")),
    _bm25("message_count", "message_length", "average_message", _idf("message_posts")),
)


def _matches(clauses: str) -> str:
    """Posts that satisfy the clauses of a query, as ``query_id, post_id, date, relevance``."""
    phrase = _bm25("times", "length", "average", "idf")
    return f"""
    WITH hits AS (
      SELECT query_id, clause_no, kind, post_id, post_date, {_WORD_SCORE} AS score
      FROM (SELECT * FROM {clauses} WHERE kind IN ('must', 'should', 'must_not')) c
      JOIN term_counts t ON t.term = c.text JOIN term_posts USING (term) CROSS JOIN lexical_totals
      UNION ALL
      SELECT query_id, clause_no, kind, post_id, post_date, sum(boost * {phrase})
      FROM (SELECT * FROM {clauses} WHERE kind = 'phrase') c
      JOIN (SELECT text, sum({_idf("title_posts")}) AS title_idf, sum({_idf("message_posts")}) AS message_idf
            FROM (SELECT text, unnest(string_split(text, ' ')) AS term
                  FROM (SELECT DISTINCT text FROM {clauses} WHERE kind = 'phrase'))
            JOIN term_posts USING (term) CROSS JOIN lexical_totals GROUP BY text) USING (text)
      JOIN (SELECT gram AS text, post_id, post_date, times, length, field = 'title' AS in_title,
                   CASE WHEN field = 'title' THEN 3e0 ELSE 1e0 END AS boost FROM grams) USING (text)
      CROSS JOIN lexical_totals
      CROSS JOIN LATERAL (SELECT CASE WHEN in_title THEN title_idf ELSE message_idf END AS idf,
                                 CASE WHEN in_title THEN average_title ELSE average_message END AS average)
      GROUP BY ALL
      UNION ALL
      SELECT query_id, clause_no, kind, post_id, post_date,
             3e0 * max((title_count > 0)::INT) + max((message_count > 0)::INT)
      FROM (SELECT * FROM {clauses} WHERE kind = 'prefix') c JOIN term_counts ON starts_with(term, c.text) GROUP BY ALL),
    wanted AS (
      SELECT query_id, count(*) FILTER (kind IN ('must', 'phrase', 'prefix')) AS needed FROM {clauses} GROUP BY query_id)
    SELECT query_id, post_id, any_value(post_date) AS date,
           coalesce(sum(score) FILTER (kind <> 'must_not'), 0) AS relevance
    FROM hits JOIN wanted USING (query_id) GROUP BY query_id, post_id, needed
    HAVING count(*) FILTER (kind IN ('must', 'phrase', 'prefix')) = needed AND count(*) FILTER (kind = 'must_not') = 0
       AND (needed > 0 OR count(*) FILTER (kind = 'should') > 0)"""


def _ranked(matches: str, queries: str) -> str:
    return f"""
    SELECT * EXCLUDE (max_results) FROM (SELECT query_id, post_id, date, score, coalesce(max_results, 10) AS max_results,
          row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, date DESC, post_id)::INT AS rank
        FROM (SELECT *, relevance + power(0.5e0, abs(date - {RECENCY_ORIGIN}) / 864000e0) AS score
              FROM {matches} JOIN {queries} USING (query_id))) WHERE rank <= max_results"""


def _hits(ranked: str) -> str:
    return f"""SELECT query_id, rank, round(score, 6) AS score, title, message, date, user_name AS user,
           thread_id AS discussion_id, node, post_id FROM {ranked} JOIN documents_by_post USING (post_id)"""


def _keyword_queries(limits: tuple) -> str:
    listed = ", ".join("NULL" if limit is None else str(limit) for limit in limits)
    return f"""SELECT item_id * {PLACES} + place AS query_id,
           CASE WHEN place = 0 THEN ' ' ELSE concat_ws(' ', ws[place], ws[place + 1]) END AS query,
           [{listed}][(place % {len(limits)} + 1)::INT]::INT AS max_results
           FROM (SELECT *, unnest(range(0, len(ws) + 1)) AS place FROM passages)"""


def _pair_clauses(first: str, second: str, last: str) -> str:
    """Clauses of the two words of every keyword request, and of a last word alone."""
    return f"""SELECT * FROM (
             SELECT item_id * {PLACES} + place AS query_id, 0 AS clause_no,
                    CASE WHEN place < len(ws) THEN '{first}' ELSE '{last}' END AS kind, ws[place] AS text FROM word_places
             UNION ALL SELECT item_id * {PLACES} + place, 1, '{second}', ws[place + 1] FROM word_places)
           WHERE text IS NOT NULL"""


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": (
        (),
        """SELECT conv_id * 8 + turn + 1 AS post_id, conv_id + 1 AS thread_id, role AS user_name, text AS message,
           (1704067200 + (conv_id * 8 + turn) * 3600)::BIGINT AS post_date FROM conversations""",
    ),
    "threads": (
        (),
        """SELECT conv_id + 1 AS thread_id, max(CASE WHEN turn = 0 THEN text END) AS title,
           max((1704067200 + (conv_id * 8 + turn) * 3600)::BIGINT) AS last_post_date, conv_id % 5 AS node
           FROM conversations GROUP BY conv_id""",
    ),
    "store": (
        (),
        """SELECT vec_id, CASE WHEN vec_id % 5 <> 4 THEN vec_id + 1 END AS post_id,
           CASE WHEN vec_id % 5 = 4 THEN vec_id // 5 + 1 END AS thread_id, embedding, 64 AS embedding_length,
           false AS is_truncated, 0 AS section, '2024-01-01 00:00:00' AS last_updated FROM embeddings""",
    ),
    "damaged": (
        ("store",),
        """SELECT * REPLACE (
             CASE vec_id % 50 WHEN 1 THEN NULL WHEN 2 THEN embedding[1:63]
               WHEN 3 THEN list_concat(embedding[1:63], ['nan'::FLOAT])
               WHEN 4 THEN list_transform(embedding, lambda x: (x * 1000)::FLOAT)
               WHEN 6 THEN list_concat(embedding[1:63], ['-inf'::FLOAT]) ELSE embedding END AS embedding,
             CASE WHEN vec_id % 50 = 5 THEN 63 ELSE 64 END AS embedding_length) FROM store""",
    ),
    "checked": (
        ("damaged",),
        """SELECT *, CASE WHEN embedding IS NULL THEN 'none' WHEN len(embedding) <> 64 THEN 'length'
             WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'nonfinite'
             WHEN list_max(list_transform(embedding, lambda x: abs(x))) > 100 THEN 'extreme' ELSE 'valid' END AS reason,
             embedding_length <> 64 AS length_issue FROM damaged""",
    ),
    "vector_queries": ((), "SELECT vec_id AS query_id, embedding FROM embeddings"),
    "text_queries": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "passages": ((), f"SELECT item_id, {_words('text')} AS ws FROM benchmark"),
    "word_places": (("passages",), "SELECT *, unnest(range(1, len(ws) + 1)) AS place FROM passages"),
    "keyword_queries": (("passages",), _keyword_queries(LIMITS)),
    "fused_queries": (("passages",), _keyword_queries(FUSED_LIMITS)),
    "must_clauses": (
        ("keyword_queries",),
        f"""SELECT query_id, 0 AS clause_no, 'must' AS kind, unnest(list_distinct({_words("query")})) AS text
            FROM keyword_queries""",
    ),
    "fused_clauses": (
        ("fused_queries",),
        f"""SELECT query_id, 0 AS clause_no, 'must' AS kind, unnest(list_distinct({_words("query")})) AS text
            FROM fused_queries""",
    ),
    "and_clauses": (("word_places",), _pair_clauses("must", "must", "must")),
    "not_clauses": (("word_places",), _pair_clauses("must", "must_not", "must")),
    "prefix_clauses": (("word_places",), _pair_clauses("must", "prefix", "prefix")),
    "or_clauses": (
        ("passages",),
        "SELECT item_id AS query_id, 0 AS clause_no, 'should' AS kind, unnest(list_distinct(ws)) AS text FROM passages",
    ),
    "phrase_clauses": (
        ("word_places",),
        f"""SELECT item_id * {PLACES} + place * 10 + n AS query_id, 0 AS clause_no, 'phrase' AS kind,
                   array_to_string(ws[place:place + n - 1], ' ') AS text
            FROM (SELECT *, unnest(range(2, 7)) AS n FROM word_places) WHERE place + n - 1 <= len(ws)""",
    ),
    "phrase_queries": (("phrase_clauses",), "SELECT query_id, NULL::INT AS max_results FROM phrase_clauses"),
    "mixed_clauses": (
        ("word_places",),
        f"""SELECT * FROM (
              SELECT item_id * {PLACES} + place AS query_id, unnest([0, 1, 2]) AS clause_no,
                     unnest(CASE place % 4 WHEN 0 THEN ['must', 'should', 'must_not'] WHEN 1 THEN ['phrase', 'should', '']
                       WHEN 2 THEN ['must', 'prefix', ''] ELSE ['should', 'should', 'must_not'] END) AS kind,
                     unnest(CASE WHEN place % 4 = 1
                       THEN [array_to_string(ws[place:place + n - 1], ' '), ws[place + n], NULL]
                       WHEN place % 4 = 2 THEN [ws[place], ws[place + 1], NULL]
                       ELSE [ws[place], ws[place + 1], ws[place + 2]] END) AS text
              FROM (SELECT *, place // 4 % 5 + 2 AS n FROM word_places)) WHERE text IS NOT NULL""",
    ),
    "mixed_queries": (
        ("word_places",),
        f"""SELECT item_id * {PLACES} + place AS query_id,
                   [{", ".join("NULL" if limit is None else str(limit) for limit in LIMITS)}][(place // 4 % 4 + 1)::INT]::INT
                     AS max_results FROM word_places""",
    ),
    "stored_hits": (("vector_queries", "store"), _nearest("vector_queries", "store", 10, "l2")),
    "stored_details": (("stored_hits", "posts", "threads"), _details("stored_hits")),
    "post_sums": (("posts",), _sums_of("posts", "post_id", "message")),
    "thread_sums": (("threads",), _sums_of("threads", "thread_id", "title")),
    "text_query_sums": (("text_queries",), _sums_of("text_queries", "query_id", "query")),
    "fused_query_sums": (("fused_queries",), _sums_of("fused_queries", "query_id", "query")),
    "post_vectors": (("post_sums",), _vectors_of("post", "post_id", "message")),
    "thread_vectors": (("thread_sums",), _vectors_of("thread", "thread_id", "title")),
    "text_query_vectors": (("text_query_sums",), _vectors_of("text_query", "query_id", "query")),
    "fused_query_vectors": (("fused_query_sums",), _vectors_of("fused_query", "query_id", "query")),
    "post_rows": (
        ("post_vectors", "posts"),
        f"""SELECT post_id, NULL::BIGINT AS thread_id, embedding, {DIM} AS embedding_length,
            len(regexp_extract_all(message, '{TOKEN_PATTERN}')) > 8191 AS is_truncated, 0 AS section,
            '{NOW}' AS last_updated FROM post_vectors JOIN posts USING (post_id)""",
    ),
    "thread_rows": (
        ("thread_vectors", "threads"),
        f"""SELECT NULL::BIGINT AS post_id, thread_id, embedding, {DIM} AS embedding_length,
            len(regexp_extract_all(title, '{TOKEN_PATTERN}')) > 8191 AS is_truncated, 0 AS section,
            '{NOW}' AS last_updated FROM thread_vectors JOIN threads USING (thread_id)""",
    ),
    "text_store": (
        ("post_vectors", "thread_vectors"),
        """SELECT post_id * 2 AS vec_id, post_id, NULL::BIGINT AS thread_id, embedding FROM post_vectors
           UNION ALL SELECT thread_id * 2 + 1, NULL, thread_id, embedding FROM thread_vectors""",
    ),
    "documents_by_post": (
        ("posts", "threads"),
        f"""SELECT post_id, post_date, title, message, user_name, thread_id, node,
            {_words("title")} AS title_words, {_words("message")} AS message_words
            FROM posts JOIN threads USING (thread_id)""",
    ),
    "lexical_totals": (
        ("documents_by_post",),
        """SELECT count(*) AS posts, sum(len(title_words))::BIGINT AS title_words,
           sum(len(message_words))::BIGINT AS message_words, avg(len(title_words)) AS average_title,
           avg(len(message_words)) AS average_message FROM documents_by_post""",
    ),
    "term_counts": (
        ("documents_by_post",),
        """SELECT post_id, post_date, title_length, message_length, term,
             count(*) FILTER (field = 'title') AS title_count, count(*) FILTER (field = 'message') AS message_count
           FROM (SELECT *, 'title' AS field, unnest(title_words) AS term,
                   len(title_words) AS title_length, len(message_words) AS message_length FROM documents_by_post
                 UNION ALL
                 SELECT *, 'message', unnest(message_words), len(title_words), len(message_words)
                 FROM documents_by_post)
           GROUP BY ALL""".replace("SELECT *,", "SELECT post_id, post_date,"),
    ),
    "term_posts": (
        ("term_counts",),
        """SELECT term, count(*) FILTER (title_count > 0) AS title_posts,
           count(*) FILTER (message_count > 0) AS message_posts FROM term_counts GROUP BY term""",
    ),
    "grams": (
        ("documents_by_post",),
        """SELECT post_id, post_date, field, length, gram, count(*) AS times
           FROM (SELECT post_id, post_date, field, len(ws) AS length, array_to_string(ws[s:s + n - 1], ' ') AS gram
                 FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s
                       FROM (SELECT *, unnest(range(1, 7)) AS n FROM (
                         SELECT post_id, post_date, 'title' AS field, title_words AS ws FROM documents_by_post
                         UNION ALL SELECT post_id, post_date, 'message', message_words FROM documents_by_post))
                       WHERE len(ws) >= n))
           GROUP BY ALL""",
    ),
    **{
        f"{name}_matches": (
            (f"{name}_clauses", "term_counts", "term_posts", "lexical_totals", "grams"), _matches(f"{name}_clauses")
        )
        for name in ("must", "fused", "and", "or", "not", "phrase", "prefix", "mixed")
    },
    "keyword_ranked": (("must_matches", "keyword_queries"), _ranked("must_matches", "keyword_queries")),
    "fused_ranked": (("fused_matches", "fused_queries"), _ranked("fused_matches", "fused_queries")),
    "mixed_ranked": (("mixed_matches", "mixed_queries"), _ranked("mixed_matches", "mixed_queries")),
    "phrase_ranked": (("phrase_matches", "phrase_queries"), _ranked("phrase_matches", "phrase_queries")),
    "keyword_hits": (("keyword_ranked", "documents_by_post"), _hits("keyword_ranked")),
    "fused_hits": (("fused_ranked", "documents_by_post"), _hits("fused_ranked")),
    "fused_vector_hits": (
        ("fused_query_vectors", "fused_queries", "text_store"),
        f"""SELECT h.* FROM ({_nearest("fused_query_vectors", "text_store", 10, "l2")}) h
            JOIN fused_queries USING (query_id) WHERE rank <= coalesce(max_results, 10)""",
    ),
    "text_vector_hits": (
        ("text_query_vectors", "text_store"),
        _nearest("text_query_vectors", "text_store", 10, "l2"),
    ),
    "text_cosine_hits": (
        ("text_query_vectors", "text_store"),
        _nearest("text_query_vectors", "text_store", 5, "cosine"),
    ),
    "combined": (
        ("fused_vector_hits", "fused_hits", "posts", "threads"),
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, source_no, rank)::INT AS position
            FROM (SELECT *, coalesce(post_date, last_post_date, 0)::BIGINT AS sort_key FROM (
              SELECT *, 0 AS source_no FROM ({_details("fused_vector_hits")})
              UNION ALL BY NAME SELECT *, 1 AS source_no FROM fused_hits))""",
    ),
}


def _with(select: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name][1]})" for name in ordered)
    return f"WITH {parts}\n{select}" if parts else select


_ROW = "post_id, thread_id, embedding_length, is_truncated, section, last_updated, " + _digest("embedding") + " AS total"

_DETAIL_JSON = """CASE WHEN type = 'post'
  THEN json_object('type', type, 'post_id', post_id, 'thread_id', thread_id, 'message', message,
                   'post_date', post_date, 'thread_title', thread_title)
  ELSE json_object('type', type, 'thread_id', thread_id, 'title', title, 'last_post_date', last_post_date) END"""

_COMBINED_JSON = f"""CASE WHEN source_no = 1
  THEN json_object('post_id', post_id, 'message', message, 'title', title, 'date', date, 'user', "user",
                   'discussion_id', discussion_id, 'node', node) ELSE {_DETAIL_JSON} END"""


def _escaped(column: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        column = f"replace({column}, '{raw}', '{entity}')"
    return column


def _progress(items: str, key: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {items}) AS total, (SELECT count(DISTINCT {key}) FROM store) AS completed,
        (SELECT count(*) FROM {items}) - (SELECT count(DISTINCT {key}) FROM store) AS pending,
        (SELECT count(*) FROM {items} WHERE {key} NOT IN (SELECT {key} FROM store WHERE {key} IS NOT NULL))
          AS truly_pending"""


def _elements(rows: str, key: str) -> str:
    return f"""SELECT {key}, position::INT AS position, round(embedding[position + 1]::DOUBLE, 6) AS value
        FROM (SELECT {key}, embedding, unnest(range({DIM})) AS position FROM {rows})"""


def _of_kept_posts(sql: str) -> str:
    """The same over an index without every tenth post."""
    return sql.replace("FROM posts JOIN threads USING (thread_id)", "FROM posts JOIN threads USING (thread_id) WHERE post_id % 10 <> 0", 1)


def _matched(name: str) -> str:
    return _with(f"SELECT query_id, post_id FROM {name}_matches", f"{name}_matches")


_MERGED_ROW = f"""s.post_id, s.thread_id,
    CASE WHEN r.post_id IS NULL THEN s.embedding_length ELSE r.embedding_length END AS embedding_length,
    CASE WHEN r.post_id IS NULL THEN s.is_truncated ELSE r.is_truncated END AS is_truncated,
    CASE WHEN r.post_id IS NULL THEN s.embedding ELSE r.embedding END AS embedding"""

_ORACLE: dict[str, str] = {
    "store_scan": _with(
        f"SELECT vec_id, post_id, thread_id, len(embedding)::INT AS dim, {_digest('embedding')} AS total FROM store",
        "store",
    ),
    "store_with_dates": _with(
        f"""SELECT vec_id, s.post_id, s.thread_id, coalesce(p.post_date, t.last_post_date) AS date,
            {_digest('embedding')} AS total FROM store s LEFT JOIN posts p ON s.post_id = p.post_id
            LEFT JOIN threads t ON s.thread_id = t.thread_id""",
        "store", "posts", "threads",
    ),
    "store_with_dates_bucketed": _with(
        f"""SELECT vec_id, s.post_id, s.thread_id, coalesce(p.post_date, t.last_post_date) AS date,
            {_digest('embedding')} AS total FROM store s LEFT JOIN posts p ON s.post_id = p.post_id
            LEFT JOIN threads t ON s.thread_id = t.thread_id""",
        "store", "posts", "threads",
    ),
    "point_lookup": _with(
        """SELECT 'post' AS type, post_id AS id, message AS content FROM posts WHERE post_id IN (SELECT post_id FROM store)
           UNION ALL SELECT 'thread', thread_id, title FROM threads WHERE thread_id IN (SELECT thread_id FROM store)""",
        "posts", "threads", "store",
    ),
    "keyset_page": _with(
        "SELECT post_id, message FROM posts WHERE post_id > 200 ORDER BY post_id LIMIT 100", "posts"
    ),
    "offset_page": _with(
        "SELECT vec_id, post_id, thread_id, embedding_length FROM store ORDER BY vec_id LIMIT 100 OFFSET 200", "store"
    ),
    "store_upsert": _with(
        f"""SELECT {_ROW} FROM (
              SELECT {_MERGED_ROW}, s.section, s.last_updated FROM store s LEFT JOIN post_rows r ON s.post_id = r.post_id
              UNION ALL BY NAME
              SELECT * FROM post_rows WHERE post_id NOT IN (SELECT post_id FROM store WHERE post_id IS NOT NULL))""",
        "store", "post_rows",
    ),
    "store_update": _with(
        f"""SELECT {_ROW} FROM (SELECT {_MERGED_ROW}, s.section,
              CASE WHEN r.post_id IS NULL THEN s.last_updated ELSE '{NOW}' END AS last_updated
              FROM store s LEFT JOIN post_rows r ON s.post_id = r.post_id)""",
        "store", "post_rows",
    ),
    "store_delete_kind": _with("SELECT vec_id, post_id, thread_id FROM store WHERE thread_id IS NULL", "store"),
    "vector_export": _with(
        f"""SELECT post_id, embedding_length, {_digest('embedding')} AS total FROM checked
            WHERE post_id > 0 AND reason = 'valid'""",
        "checked",
    ),
    "index_build_if_missing": _with(
        f"SELECT vec_id, post_id, thread_id, embedding_length, {_digest('embedding')} AS total FROM store", "store"
    ),
    "query_batch": _with(
        """SELECT query_id, query, coalesce(max_results, 10) AS max_results FROM keyword_queries
           WHERE length(trim(query)) > 0""",
        "keyword_queries",
    ),
    "results_json": _with(
        f"""SELECT query_id, '{{"faiss_results":[' || string_agg(({_DETAIL_JSON})::VARCHAR, ',' ORDER BY rank) || ']}}'
            AS response FROM stored_details GROUP BY query_id""",
        "stored_details",
    ),
    "keyword_json": _with(
        """SELECT query_id, '{"elasticsearch_results":[' || coalesce(string_agg(CASE WHEN post_id IS NOT NULL THEN json_object('title', title, 'message', message,
              'date', date, 'user', "user", 'discussion_id', thread_id, 'node', node, 'post_id', post_id)::VARCHAR END, ','
              ORDER BY rank), '') || ']}' AS response
            FROM fused_queries LEFT JOIN (SELECT *, thread_id, user_name AS user, post_date AS date FROM
              (SELECT query_id, rank, post_id FROM fused_ranked) JOIN documents_by_post USING (post_id)) h USING (query_id)
            WHERE length(trim(query)) > 0 GROUP BY query_id""",
        "fused_queries", "fused_ranked", "documents_by_post",
    ),
    "results_from_json": _with(
        """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INT AS position,
           type, post_id, thread_id, message, post_date, thread_title, title, last_post_date FROM stored_details""",
        "stored_details",
    ),
    "combined_json": _with(
        f"""SELECT query_id,
              '{{"faiss_results":[' || coalesce(string_agg(j, ',' ORDER BY rank) FILTER (source_no = 0), '')
              || '],"elasticsearch_results":[' || coalesce(string_agg(j, ',' ORDER BY rank) FILTER (source_no = 1), '')
              || '],"combined_results":[' || coalesce(string_agg(j, ',' ORDER BY position), '') || ']}}' AS response
            FROM fused_queries LEFT JOIN (SELECT *, ({_COMBINED_JSON})::VARCHAR AS j FROM combined) USING (query_id)
            WHERE length(trim(query)) > 0 GROUP BY query_id""",
        "combined", "fused_queries",
    ),
    "lexical_project": _with("SELECT * EXCLUDE (score) FROM keyword_hits", "keyword_hits"),
    "store_kind": _with(
        """SELECT vec_id, CASE WHEN coalesce(post_id, 0) <> 0 THEN 'post' WHEN coalesce(thread_id, 0) <> 0 THEN 'thread' END
           AS type FROM store""",
        "store",
    ),
    "in_hits_semi": _with(
        "SELECT post_id, thread_id, message FROM posts WHERE post_id IN (SELECT post_id FROM stored_hits)",
        "posts", "stored_hits",
    ),
    "missing_ids": _with(
        "SELECT DISTINCT post_id FROM store WHERE post_id > 0 AND post_id NOT IN (SELECT post_id FROM posts)",
        "store", "posts",
    ),
    "validate_vectors": _with("SELECT vec_id, reason FROM checked", "checked"),
    "stored_length_issues": _with(
        "SELECT vec_id, embedding_length, reason FROM checked WHERE length_issue", "checked"
    ),
    "pending_posts": _with(
        "SELECT post_id, message FROM posts WHERE post_id > 0 AND post_id NOT IN (SELECT post_id FROM store WHERE post_id > 0)",
        "posts", "store",
    ),
    "pending_threads": _with(
        """SELECT thread_id, title FROM threads
           WHERE thread_id > 0 AND thread_id NOT IN (SELECT thread_id FROM store WHERE thread_id > 0)""",
        "threads", "store",
    ),
    "post_details": _with(
        """SELECT post_id, thread_id, message, post_date, title AS thread_title
           FROM posts JOIN threads USING (thread_id)""",
        "posts", "threads",
    ),
    "repair_candidates": _with(
        """SELECT post_id, reason, length_issue, message FROM checked JOIN posts USING (post_id)
           WHERE reason <> 'valid' OR length_issue""",
        "checked", "posts",
    ),
    "knn_l2_topk": _with("SELECT * REPLACE (round(distance, 6) AS distance) FROM stored_hits", "stored_hits"),
    "knn_cosine_topk": _with(
        f"""SELECT * REPLACE (round(similarity, 6) AS similarity)
            FROM ({_nearest("vector_queries", "store", 5, "cosine")})""",
        "vector_queries", "store",
    ),
    "orphan_vectors": _with(
        """SELECT vec_id, 'post' AS type, post_id, thread_id FROM store
           WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM posts)
           UNION ALL SELECT vec_id, 'thread', post_id, thread_id FROM store
           WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT thread_id FROM threads)""",
        "store", "posts", "threads",
    ),
    "resolve_details": _with("SELECT * FROM stored_details", "stored_details"),
    "store_counts": _with(
        """SELECT count(*) AS vectors, count(post_id) AS post_vectors, count(thread_id) AS thread_vectors FROM store""",
        "store",
    ),
    "progress_posts": _with(_progress("posts", "post_id"), "posts", "store"),
    "progress_threads": _with(_progress("threads", "thread_id"), "threads", "store"),
    "check_report": _with(
        """SELECT reason, count(*) AS vectors, count(*) FILTER (reason <> 'valid' OR length_issue) AS issues
           FROM checked GROUP BY reason""",
        "checked",
    ),
    "repair_report": _with(
        """SELECT reason, count(*) AS repaired FROM checked JOIN posts USING (post_id)
           WHERE reason <> 'valid' OR length_issue GROUP BY reason""",
        "checked", "posts",
    ),
    "export_report": _with(
        """SELECT count(*) AS processed, count(*) FILTER (reason = 'valid') AS exported FROM checked WHERE post_id > 0""",
        "checked",
    ),
    "lexical_stats": _with(
        """SELECT posts, title_words, message_words, round(average_title, 6) AS average_title,
           round(average_message, 6) AS average_message FROM lexical_totals""",
        "lexical_totals",
    ),
    "lexical_doc_freq": _with("SELECT * FROM term_posts", "term_posts"),
    "store_dimension": _with(
        """SELECT min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim,
           count(*) FILTER (len(embedding) <> 64) AS unexpected FROM damaged""",
        "damaged",
    ),
    "distinct_embedded_ids": _with("SELECT DISTINCT post_id FROM store WHERE post_id IS NOT NULL", "store"),
    "dedup_last_wins": _with(
        """SELECT post_id, thread_id, user_name, message, post_date FROM (
             SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY post_date DESC) AS n FROM posts) WHERE n = 1""",
        "posts",
    ),
    "blob_roundtrip": _with(
        f"SELECT vec_id, len(embedding)::INT * 4 AS bytes, {_digest('embedding')} AS total FROM store", "store"
    ),
    "vector_norms": _with(
        """SELECT vec_id, round(list_inner_product(a, b), 6) AS dot_with_reverse,
           round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)
             AS distance_to_reverse,
           round(list_cosine_similarity(a, b), 6) AS cosine_with_reverse, round(sqrt(list_inner_product(a, a)), 6) AS norm
           FROM (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding::DOUBLE[]) AS b FROM store)""",
        "store",
    ),
    "vector_maxabs": _with(
        """SELECT vec_id, CASE WHEN embedding IS NOT NULL
             THEN len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 END AS finite,
           CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
             THEN round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 6) END AS max_abs FROM damaged""",
        "damaged",
    ),
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS tokens FROM documents",
    "truncate_text": f"""SELECT doc_id, over AS is_truncated, length(kept)::INT AS characters, md5(kept) AS digest FROM (
        SELECT doc_id, len(tokens) > {TRUNCATE_AT} AS over,
        CASE WHEN len(tokens) > {TRUNCATE_AT} THEN array_to_string(tokens[1:{TRUNCATE_AT}], '') ELSE text END AS kept
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN_PATTERN}') AS tokens FROM documents))""",
    "html_escape": f"SELECT page_id, {_escaped('html')} AS escaped FROM pages",
    "recency_decay": _with(
        f"SELECT post_id, round(power(0.5e0, abs(post_date - {RECENCY_ORIGIN}) / 864000e0), 6) AS decay FROM posts",
        "posts",
    ),
    "lexical_match_and": _matched("and"),
    "lexical_match_or": _matched("or"),
    "lexical_match_not": _matched("not"),
    "lexical_match_phrase": _matched("phrase"),
    "lexical_match_prefix": _matched("prefix"),
    "lexical_score": _with(
        "SELECT query_id, post_id, round(relevance, 6) AS relevance FROM must_matches", "must_matches"
    ),
    "lexical_topk": _with(
        "SELECT query_id, rank, round(score, 6) AS score, post_id, date FROM keyword_ranked", "keyword_ranked"
    ),
    "lexical_search": _with("SELECT * FROM keyword_hits", "keyword_hits"),
    "lexical_search_saved": _with("SELECT * FROM keyword_hits", "keyword_hits"),
    "lexical_search_clauses": _with(_hits("mixed_ranked"), "mixed_ranked", "documents_by_post"),
    "lexical_search_clauses_saved": _with(_hits("mixed_ranked"), "mixed_ranked", "documents_by_post"),
    "lexical_search_phrases_saved": _with(_hits("phrase_ranked"), "phrase_ranked", "documents_by_post"),
    "lexical_search_segments": _of_kept_posts(_with("SELECT * FROM keyword_hits", "keyword_hits")),
    "queries_without_hits": _with(
        f"""SELECT query_id, 'No results found for "' || {_escaped('query')} || '".' AS message FROM keyword_queries
            WHERE length(trim(query)) > 0 AND query_id NOT IN (SELECT query_id FROM must_matches)""",
        "keyword_queries", "must_matches",
    ),
    "embed_posts": _with(_elements("post_vectors", "post_id"), "post_vectors"),
    "embed_threads": _with(_elements("thread_vectors", "thread_id"), "thread_vectors"),
    "embed_queries": _with(_elements("text_query_vectors", "query_id"), "text_query_vectors"),
    "vector_search": _with(_details("text_vector_hits"), "text_vector_hits", "posts", "threads"),
    "cosine_search": _with(
        """SELECT query_id, rank, vec_id, post_id, thread_id, round(similarity, 6) AS similarity,
           printf('%.4f', similarity) AS similarity_text FROM text_cosine_hits""",
        "text_cosine_hits",
    ),
    "format_similarity": _with(
        "SELECT query_id, rank, post_id, printf('%.4f', similarity) AS similarity_text FROM text_cosine_hits",
        "text_cosine_hits",
    ),
    "combined_search": _with("SELECT * FROM combined", "combined"),
    "render_results": _with(
        f"""SELECT query_id, rank, {_escaped('coalesce(thread_title, title)')} AS heading,
            {_escaped("coalesce(message, '')")} AS body,
            strftime(make_timestamp(coalesce(post_date, last_post_date) * 1000000), '%Y-%m-%d %H:%M:%S') AS posted_at
            FROM stored_details""",
        "stored_details",
    ),
    "backfill_batch": _with(
        f"""SELECT {_ROW} FROM (SELECT * EXCLUDE (vec_id) FROM store UNION ALL BY NAME
              SELECT * FROM post_rows WHERE post_id NOT IN (SELECT post_id FROM store WHERE post_id IS NOT NULL))""",
        "store", "post_rows",
    ),
    "repair_store": _with(
        f"""SELECT c.post_id, c.thread_id,
              CASE WHEN fixed THEN r.embedding_length ELSE c.embedding_length END AS embedding_length,
              CASE WHEN fixed THEN r.is_truncated ELSE c.is_truncated END AS is_truncated,
              CASE WHEN fixed THEN '{NOW}' ELSE c.last_updated END AS last_updated,
              CASE WHEN fixed THEN 'valid' ELSE reason END AS reason,
              CASE WHEN fixed THEN {_digest('r.embedding')}
                WHEN reason NOT IN ('none', 'nonfinite') THEN {_digest('c.embedding')} END AS total
            FROM (SELECT checked.*, post_id IN (SELECT post_id FROM post_rows) AND (reason <> 'valid' OR length_issue)
                    IS TRUE AS fixed FROM checked) c LEFT JOIN post_rows r ON c.post_id = r.post_id""",
        "checked", "post_rows",
    ),
    "rebuild_store": _with(
        f"""SELECT {_ROW} FROM (SELECT * EXCLUDE (vec_id) FROM store WHERE thread_id IS NULL
              UNION ALL BY NAME SELECT * FROM thread_rows)""",
        "store", "thread_rows",
    ),
    "refresh_ids": _with(
        f"""SELECT {_ROW} FROM (SELECT {_MERGED_ROW}, s.section, s.last_updated FROM store s LEFT JOIN
              (SELECT * FROM post_rows WHERE post_id IN
                (SELECT post_id FROM checked WHERE reason <> 'valid' OR length_issue)) r ON s.post_id = r.post_id)""",
        "store", "post_rows", "checked",
    ),
}


_ORACLE["store_upsert_keyed"] = _ORACLE["store_upsert"]
_ORACLE["vector_export_versions"] = _ORACLE["vector_export"]


def all_oracles() -> dict[str, str]:
    return dict(_ORACLE)
