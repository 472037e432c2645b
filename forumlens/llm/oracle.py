"""Equivalent SQL, written for DuckDB, for the queries that SQL can express on whole tables."""

from __future__ import annotations

from forumlens.llm.chat import ASSISTANT, CLOSE, END, OPEN, ROLE_ESCAPES, TEXT_ESCAPES
from forumlens.llm.decontamination import WORD_PATTERN
from forumlens.llm.licences import EQUIVALENT_WORDS, KNOWN_TEXTS, NO_OWNER, NOTICE_LINE, OWNER, OWNER_NAME, SEPARATORS
from forumlens.llm.linkgraph import ALLOW, BLOCK, DAMPING, LINK, THRESHOLD, URL_PARTS, WAVES
from forumlens.llm.queries import PLANTED_CONVERSATION, PLANTED_TEXT, URL_RULES
from forumlens.llm.ranked_search import RESULTS, TERM_PATTERN


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(column: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate({column}, '{upper}', '{upper.lower()}'), '{WORD_PATTERN}')"


def _decontamination(n: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, coalesce({_words("text")}, []) AS w FROM documents),
    i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
    grams AS (
      SELECT DISTINCT item_id, least(len(w), {n}) AS size, array_to_string(w[s:s + {n} - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM grams),
    windows AS (
      SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS gram FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
    hits AS (SELECT doc_id, s, size, item_id FROM windows JOIN grams USING (size, gram)),
    places AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
    found AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _escaped(column: str, table) -> str:
    for plain, escaped in table:
        column = f"replace({column}, {_text(plain)}, {_text(escaped)})"
    return column


def _prefix_targets() -> str:
    head = f"{len(OPEN) + len(CLOSE)} + length({_escaped('role', ROLE_ESCAPES)})"
    body = f"length({_escaped('text', TEXT_ESCAPES)})"
    planted = f"SELECT {PLANTED_CONVERSATION}, turn, role, {_text(PLANTED_TEXT)}"
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL {planted} FROM (VALUES (0, 'user'), (1, '{ASSISTANT}')) AS v(turn, role)),
    placed AS (
      SELECT *, row_number() OVER place AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
             sum({head} + {body} + {len(END)}) OVER place AS chars
      FROM turns WINDOW place AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256,
           sum(chars) FILTER (WHERE role = '{ASSISTANT}' OR n = turns)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id"""


def _lines(column: str) -> str:
    return f"string_split(replace(lower(coalesce({column}, '')), chr(13) || chr(10), chr(10)), chr(10)) AS ls"


def _canonical() -> str:
    """The canonical form of a text whose lines are the column ``ls``."""
    named = f"""regexp_matches(l, {_text(f"^{OWNER}{OWNER_NAME}$")})
      AND NOT regexp_matches(l, {_text(f"^{OWNER}(?:{NO_OWNER})(?:[^a-z0-9]|$)")})"""
    notice = f"regexp_matches(l, {_text(NOTICE_LINE)}) OR (i < len(ls) AND (i = 1 OR ls[i - 1] = '') AND {named})"
    form = f"array_to_string(list_transform(ls, lambda l, i: CASE WHEN {notice} THEN '' ELSE l END), chr(10))"
    form = f"replace(regexp_replace({form}, {_text(SEPARATORS)}, '  ', 'g'), chr(10), '  ' || chr(10) || '  ')"
    form = f"('  ' || {form} || '  ')"
    for other, usual in EQUIVALENT_WORDS.items():
        form = f"replace({form}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return form


def _licences() -> str:
    def digest(form: str) -> str:
        return f"sha256(trim(regexp_replace({form}, '[ \\n]+', ' ', 'g')))"

    known = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in KNOWN_TEXTS)
    return f"""
    WITH known AS (
      SELECT {digest(_canonical())} AS d, min(licence) AS licence
      FROM (SELECT licence, {_lines("text")} FROM (VALUES {known}) AS k(licence, text)) GROUP BY d),
    forms AS (SELECT doc_id, {_canonical()} AS form FROM (SELECT doc_id, {_lines("text")} FROM documents)),
    notices AS (
      SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM (SELECT doc_id, {digest("line")} AS d
            FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM forms)) JOIN known USING (d)
      GROUP BY doc_id)
    SELECT doc_id, {digest("form")} AS text_digest, licence, coalesce(notices, '') AS notices
    FROM forms LEFT JOIN known ON d = {digest("form")} LEFT JOIN notices USING (doc_id)"""


def _warc() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hexadecimal digits are four digits of base 32.
    number = "('0x' || substr(sha1(html), part * 5 + 1, 5))::INTEGER"
    part = " || ".join(f"substr('{digits}', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
    WITH payloads AS (
      SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(8), lambda part: {part}), '') AS payload_digest,
           CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> newest THEN newest END AS refers_to
    FROM payloads"""


def _ranked_search() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{TERM_PATTERN}')"
    return f"""
    WITH d AS (SELECT doc_id, {found} AS ws FROM documents),
    total AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0),
    asked AS (
      SELECT item_id, term, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY ALL),
    held AS (
      SELECT doc_id, n, term, count(*)::BIGINT AS tf
      FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM held CROSS JOIN total GROUP BY term, docs),
    scored AS (
      SELECT item_id, doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
      FROM asked JOIN held USING (term) JOIN weights USING (term) CROSS JOIN total GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
      FROM scored WHERE score > 0)
    WHERE rank <= {RESULTS}"""


def _link_graph() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = ", ".join(f"({_text(place.partition('/')[0])}, {_text('/' + place.partition('/')[2])}, '{v}')" for v, place in URL_RULES)

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, {_text(URL_PARTS)}, 1), ''), '{upper}', '{upper.lower()}')"

    def path(url: str) -> str:
        return f"coalesce(regexp_extract({url}, {_text(URL_PARTS)}, 2), '')"

    def judged(urls: str) -> str:
        fits = "(host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)"
        best = "length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, v DESC"
        return f"""
      SELECT u.*, rule, v AS ruled FROM {urls} u LEFT JOIN (
        SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, v
        FROM (SELECT DISTINCT host, path FROM {urls}) JOIN rules ON {fits} ORDER BY host, path, {best}) USING (host, path)"""

    waves = "".join(
        f"""
    w{n} AS MATERIALIZED (
      SELECT a.side, a.target AS host, sum(w.rank * a.share * {DAMPING}e0) AS rank
      FROM arcs a JOIN w{n - 1} w ON a.side = w.side AND a.origin = w.host GROUP BY a.side, a.target),"""
        for n in range(1, WAVES + 1)
    )
    every = " UNION ALL ".join(f"SELECT side, host, rank FROM w{n}" for n in range(WAVES + 1))
    return f"""
    WITH rules(rule_host, rule_path, v) AS (VALUES {rules}),
    urls AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path FROM pages),
    named AS (
      SELECT source, CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END AS link
      FROM (SELECT {host("url")} AS source, unnest(regexp_extract_all(html, {_text(LINK)}, 1)) AS link FROM pages)),
    linked AS (
      SELECT source, host, path, count(*) AS times
      FROM (SELECT source, {host("link")} AS host, {path("link")} AS path FROM named)
      WHERE host <> '' AND host <> source GROUP BY ALL),
    own AS ({judged("urls")}),
    others AS ({judged("linked")}),
    counted AS (
      SELECT host, sum(times) AS n, sum(CASE WHEN ruled = '{ALLOW}' THEN times ELSE 0 END) AS good,
             sum(CASE WHEN ruled = '{BLOCK}' THEN times ELSE 0 END) AS bad
      FROM (SELECT host, ruled, 1 AS times FROM own UNION ALL SELECT host, ruled, times FROM others)
      WHERE host <> '' GROUP BY host),
    edges AS (SELECT source, host, sum(times) AS times FROM linked WHERE source <> '' GROUP BY source, host),
    ways AS (
      SELECT '{ALLOW}' AS side, source AS origin, host AS target, times FROM edges
      UNION ALL SELECT '{BLOCK}', host, source, times FROM edges),
    arcs AS (SELECT side, origin, target, times / sum(times) OVER (PARTITION BY side, origin) AS share FROM ways),
    w0 AS MATERIALIZED (
      SELECT '{ALLOW}' AS side, host, good / n * {1 - DAMPING}e0 AS rank FROM counted WHERE good > 0
      UNION ALL SELECT '{BLOCK}', host, bad / n * {1 - DAMPING}e0 FROM counted WHERE bad > 0),{waves}
    ranks AS (SELECT side, host, sum(rank) AS rank FROM ({every}) GROUP BY side, host),
    hosts AS (
      SELECT host, coalesce(sum(rank) FILTER (side = '{ALLOW}'), 0) AS trust,
             coalesce(sum(rank) FILTER (side = '{BLOCK}'), 0) AS distrust
      FROM ranks GROUP BY host)
    SELECT page_id, own.host, own.path, rule,
           coalesce(ruled, CASE WHEN round(distrust / (trust + distrust), 9) > {THRESHOLD} THEN '{BLOCK}' END, '{ALLOW}') AS verdict
    FROM own LEFT JOIN hosts ON own.host = hosts.host"""


def all_oracles() -> dict[str, str]:
    return {
        "op4_warc": _warc(),
        "op5_decontamination": _decontamination(10),
        "op9_prefix_targets": _prefix_targets(),
        "op10_licences": _licences(),
        "op11_ranked_search": _ranked_search(),
        "op12_link_graph": _link_graph(),
    }
