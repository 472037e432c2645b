import math
import random

import pytest
import regex
from helpers import forum, rows_of
from pyspark.sql import functions as F

from forumlens.operators import clauses, joins, keyword_index, lexical, phrases
from forumlens.operators.ranking import BatchFigures, batch_figures
from forumlens.plans import search
from forumlens.sources import tables

QUERIES = "query_id bigint, query string, max_results int"
CLAUSES = "query_id bigint, clause_no int, kind string, text string"
POSTS = "post_id bigint, thread_id bigint, user_name string, message string, post_date bigint"
THREADS = "thread_id bigint, title string, last_post_date bigint, node bigint"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def occurrences(phrase, field):
    return sum(field[i : i + len(phrase)] == phrase for i in range(len(field) - len(phrase) + 1))


def brute_force(documents, asked):
    """Matches of clauses with their relevance, straight from the texts: ``asked`` lists (query, kind, text)."""
    docs = {r["post_id"]: (words(r["title"]), words(r["message"])) for r in documents.collect()}
    average = [sum(len(d[f]) for d in docs.values()) / len(docs) for f in (0, 1)]

    def idf(word, place):
        matching = sum(word in d[place] for d in docs.values())
        return math.log(1 + (len(docs) - matching + 0.5) / (matching + 0.5))

    def score(phrase, fields):
        total = 0.0
        for place, (field, boost) in enumerate(zip(fields, (3.0, 1.0))):
            times = occurrences(phrase, field)
            if times:
                norm = 1.2 * (0.25 + 0.75 * len(field) / average[place])
                total += boost * sum(idf(w, place) for w in phrase) * times * 2.2 / (times + norm)
        return total

    out = []
    for query in sorted({q for q, _, _ in asked}):
        for post_id, fields in docs.items():
            total, required, forbidden, optional, any_required = 0.0, True, False, False, False
            for _, kind, text in (a for a in asked if a[0] == query):
                for phrase in [words(text)] if kind in ("phrase", "prefix") else [[w] for w in words(text)] or [[]]:
                    if kind == "prefix":
                        begins = [any(w.startswith(phrase[0]) for w in f) if phrase else False for f in fields]
                        found, weight = any(begins), 3.0 * begins[0] + 1.0 * begins[1]
                    else:
                        found = bool(phrase) and any(occurrences(phrase, f) for f in fields)
                        weight = score(phrase, fields) if found else 0.0
                    any_required |= kind in clauses.REQUIRED
                    required &= found or kind not in clauses.REQUIRED
                    forbidden |= found and kind == "must_not"
                    optional |= found and kind == "should"
                    total += weight if kind != "must_not" else 0.0
            if required and not forbidden and (any_required or optional):
                out.append((query, post_id, round(total, 9)))
    return sorted(out, key=repr)


def matched(index, asked):
    found = clauses.matches(index, clauses.Units(asked))
    return rows_of(found.withColumn("relevance", F.round("relevance", 9)), "query_id", "post_id", "relevance")


def fresh(posts, threads, asked, span=2):
    return matched(clauses.index_for(posts, threads, clauses.Units(asked), span), asked)


@pytest.fixture(scope="module")
def tables_of(spark):
    return forum(spark)


@pytest.fixture(scope="module")
def saved(tables_of, tmp_path_factory):
    return keyword_index.add(*tables_of, str(tmp_path_factory.mktemp("index")), buckets=4, span=2)


ASKED = [
    (1, "quick brown", None),
    (2, "QUICK quick", 2),
    (3, "fox facts", None),
    (4, "größe", None),
    (5, "absent word", None),
    (6, "", None),
    (7, None, None),
    (8, "the", 1),
]


def test_words_of_queries_equal_brute_force(spark, tables_of, saved):
    asked = clauses.must_clauses(spark.createDataFrame(ASKED, QUERIES))
    listed = [(q, "must", w) for q, text, _ in ASKED for w in dict.fromkeys(words(text))]
    expected = brute_force(lexical.lexical_documents(*tables_of), listed)
    assert fresh(*tables_of, asked) == expected
    assert matched(saved, asked) == expected


CASES = [
    [("must", "quick"), ("must", "brown")], [("should", "lazy"), ("should", "answer")], [("must", "quick"), ("must_not", "lazy")],
    [("must", "quick"), ("should", "lazy")], [("must_not", "lazy")], [("phrase", "quick brown")], [("phrase", "Brown Fox")],
    [("phrase", "facts the")], [("phrase", "quick brown fox jumps over")], [("phrase", "quick brown fox jumps under")],
    [("prefix", "tabell")], [("prefix", "grö")], [("prefix", "fox"), ("prefix", "qu")], [("prefix", "fox"), ("must", "see")],
    [("should", "fox"), ("must_not", "fox")], [("phrase", "quick quick")], [("phrase", "fox")], [("must", "quick brown")],
    [("must", "?")], [("should", "?"), ("should", "lazy")], [("phrase", ""), ("should", "fox")], [("prefix", "q"), ("should", "größen")],
    [("must", None)], [("should", "the"), ("must_not", "absent")], [("phrase", "the quick brown"), ("phrase", "lazy dog"), ("prefix", "j")],
]


def test_clauses_equal_brute_force(spark, tables_of, saved):
    listed = [(n, kind, text) for n, case in enumerate(CASES) for kind, text in case]
    asked = spark.createDataFrame([(n, i, k, t) for n, case in enumerate(CASES) for i, (k, t) in enumerate(case)], CLAUSES)
    expected = brute_force(lexical.lexical_documents(*tables_of), listed)
    assert fresh(*tables_of, asked) == expected
    assert matched(saved, asked) == expected


def drawn(spark, count, seed, vocabulary=30):
    """Posts over few words, one of which all have; busy threads; words repeat side by side."""
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    text = lambda most: " ".join(["stop"] + draw.choices(names, range(1, vocabulary + 1), k=draw.randint(0, most)))
    posts = [(i, 1 if i % 3 else i, "u", text(25), 1000 * (i % 40)) for i in range(1, count + 1)]
    threads = [(i, text(4), 0, 0) for i in {p[1] for p in posts}]
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(threads, THREADS), draw, names


def test_phrases_of_repeated_words(spark, tmp_path):
    posts, threads, draw, _ = drawn(spark, 150, 1, vocabulary=3)
    listed = [(n, "phrase", " ".join(draw.choices(["w0", "w1", "w2", "stop"], k=2 + n % 5))) for n in range(40)]
    asked = spark.createDataFrame([(n, 0, kind, text) for n, kind, text in listed], CLAUSES)
    expected = brute_force(lexical.lexical_documents(posts, threads), listed)
    assert expected and fresh(posts, threads, asked, 16) == expected
    assert matched(keyword_index.add(posts, threads, str(tmp_path), 4, 16), asked) == expected


@pytest.mark.parametrize("first_spans", [1, 1000])
def test_ranking_reads_only_what_can_matter(spark, first_spans, monkeypatch):
    posts, threads, draw, names = drawn(spark, 400, 2)
    listed = [(0, "must", "stop"), (1, "should", "stop"), (1, "should", "w3"), (2, "must", "w1"), (2, "should", "w29")]
    for n in range(3, 25):
        listed += [(n, draw.choice(["must", "should", "should", "must_not"]), draw.choice(names)) for _ in range(3)]
        listed += [(n, "prefix", f"w{n % 10}")] * (n % 4 == 0) + [(n, "phrase", f"stop w{n}")] * (n % 5 == 0)
    asked = spark.createDataFrame([(q, i, k, t) for i, (q, k, t) in enumerate(listed)], CLAUSES)
    limits = [(n, (None, 1, 3, 2000)[n % 4]) for n in range(25)]
    queries = spark.createDataFrame(limits, "query_id bigint, max_results int")
    units, origin = clauses.Units(asked), 20_000
    index = clauses.index_for(posts, threads, units, span=8)
    read = []
    score = clauses.Search.scores
    monkeypatch.setattr(clauses.Search, "scores", lambda self, spans: read.append(spans.collect()) or score(self, spans))
    found = clauses.ranked(index, units, queries, F.lit(origin), first_spans)
    dates = {r["post_id"]: r["post_date"] for r in posts.collect()}
    expected = {}
    for query, post, relevance in brute_force(lexical.lexical_documents(posts, threads), listed):
        score_of = relevance + 0.5 ** (abs(dates[post] - origin) / 864000)
        expected.setdefault(query, []).append((-round(score_of, 8), -dates[post], post))
    got = {}
    for row in found.collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["post_id"]))
    for query, most in limits:
        best = sorted(expected.get(query, []))[: 10 if most is None else most]
        assert [post for _, post in sorted(got.get(query, []))] == [post for _, _, post in best], query
    if first_spans == 1:
        of_one = [row for rows in read for row in rows if row["query_id"] == 1]
        assert len(of_one) < 50 / 2  # 50 spans hold the stop word; the query wants one post


def test_many_required_words(spark):
    text = " ".join(f"w{i}" for i in range(150))
    posts = spark.createDataFrame([(1, 1, "u", text, 0), (2, 1, "u", text.replace("w70 ", ""), 0)], POSTS)
    threads = spark.createDataFrame([(1, "t", 0, 0)], THREADS)
    asked = clauses.must_clauses(spark.createDataFrame([(1, text, None), (2, text.replace("w70 ", ""), None)], QUERIES))
    assert [(q, p) for q, p, _ in fresh(posts, threads, asked)] == [(1, 1), (2, 1), (2, 2)]


def test_joins_without_broadcast_give_the_same(spark, tables_of, monkeypatch):
    asked = spark.createDataFrame([(n, i, k, t) for n, case in enumerate(CASES) for i, (k, t) in enumerate(case)], CLAUSES)
    expected = fresh(*tables_of, asked)
    monkeypatch.setattr(clauses, "BROADCAST_ROWS", -1)
    assert fresh(*tables_of, asked) == expected


def test_long_texts_of_few_clauses_are_not_broadcast(spark, tables_of, monkeypatch):
    asked = spark.createDataFrame([(1, 0, "phrase", "quick brown"), (1, 1, "must", "fox"), (2, 0, "must", "größe")], CLAUSES)
    expected = fresh(*tables_of, asked)
    assert clauses.Units(asked).few and expected
    monkeypatch.setattr(clauses, "BROADCAST_BYTES", len("quick brownfoxgröße".encode()) - 1)
    assert not clauses.Units(asked).few
    assert fresh(*tables_of, asked) == expected


def test_no_posts_and_no_clauses(spark, tables_of):
    posts, threads = tables_of
    asked = spark.createDataFrame([(1, 0, "must", "quick"), (2, 0, "prefix", "q")], CLAUSES)
    assert fresh(posts.where("false"), threads, asked) == []
    assert fresh(posts, threads, asked.where("false")) == []
    assert rows_of(search.keyword_hits(spark.createDataFrame([], QUERIES), posts, threads, F.lit(0))) == []


def figures_of(index):
    return rows_of(index.corpus), rows_of(index.terms, "term", "title_posts", "message_posts")


def test_segments_equal_an_index_built_anew(spark, tmp_path):
    posts, threads, draw, names = drawn(spark, 120, 3)
    listed = [(n, kind, text) for n in range(30) for kind, text in [("must", draw.choice(names)), ("should", draw.choice(names))]]
    listed += [(100 + n, "phrase", f"stop w{n}") for n in range(30)] + [(200 + n, "prefix", f"w{n}") for n in range(10)]
    asked = spark.createDataFrame([(q, i, k, t) for i, (q, k, t) in enumerate(listed)], CLAUSES)
    folder = str(tmp_path / "segments")
    for part in range(3):
        keyword_index.add(posts.where(F.col("post_id") % 3 == part), threads, folder, 4, 16)
    changed = posts.where("post_id % 7 = 1").withColumn("message", F.concat(F.lit("new w5 w5 "), "message"))
    keyword_index.add(changed, threads, folder)  # replaces what the index has of these posts
    gone = posts.where("post_id % 5 = 0").select("post_id").union(spark.createDataFrame([(9999,)], "post_id bigint"))
    index = keyword_index.delete(spark, folder, gone)
    left = posts.where("post_id % 7 <> 1").unionByName(changed).where("post_id % 5 <> 0")
    anew = keyword_index.add(left, threads, str(tmp_path / "anew"), 4, 16)
    assert figures_of(index) == figures_of(anew)
    expected = brute_force(lexical.lexical_documents(left, threads), listed)
    assert matched(index, asked) == expected == matched(anew, asked)
    packed = keyword_index.compact(spark, folder)
    assert packed.deleted is None and figures_of(packed) == figures_of(anew)
    assert matched(packed, asked) == expected


def test_a_writer_that_stops_leaves_the_index_as_it_was(spark, tables_of, tmp_path, monkeypatch):
    posts, threads = tables_of
    folder = str(tmp_path)
    keyword_index.add(posts.where("post_id < 4"), threads, folder, 4, 2)
    before = figures_of(keyword_index.read(spark, folder))
    publish = keyword_index.publish
    monkeypatch.setattr(keyword_index, "publish", lambda *args: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        keyword_index.add(posts.where("post_id >= 4"), threads, folder)
    assert figures_of(keyword_index.read(spark, folder)) == before
    monkeypatch.setattr(keyword_index, "publish", publish)
    index = keyword_index.add(posts.where("post_id >= 4"), threads, folder)
    assert rows_of(index.corpus, "posts") == [(5,)]
    with pytest.raises(ValueError):
        keyword_index.read(spark, str(tmp_path / "nothing"))


def test_index_holds_positions_and_no_text(saved):
    assert "message" not in saved.postings.columns and "title" not in saved.postings.columns
    quick = saved.postings.where("term = 'quick' and post_id = 2 and field = 1").first()
    assert (quick["positions"], quick["length"]) == ([1, 5, 6], 7)


def test_saved_index_reads_only_the_asked_buckets(spark, saved):
    asked = clauses.must_clauses(spark.createDataFrame([(1, "quick", None)], QUERIES))
    plan = clauses.matches(saved, clauses.Units(asked))._jdf.queryExecution().executedPlan().toString()
    postings = [l for l in plan.splitlines() if "FileScan" in l and "positions" in l]
    assert postings and all("dynamicpruning" in line for line in postings)


def test_messages_do_not_move(tables_of):
    plan = keyword_index.field_postings(*tables_of)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange" in line and ("message" in line or "words" in line))


def test_figures_of_a_batch(spark):
    assert batch_figures(spark.createDataFrame(ASKED, QUERIES)) == BatchFigures(8, 9, 10)
    assert batch_figures(spark.createDataFrame([], QUERIES)) == BatchFigures(0, 0, 0)


def test_requests_cover_whole_passages(spark, small):
    passages = {r["query_id"]: words(r["query"]) for r in tables.text_queries(spark, small).collect()}
    pairs = {}
    for row in tables.keyword_queries(spark, small).collect():
        pairs.setdefault(row["query_id"] // tables.PLACES, []).append((row["query_id"] % tables.PLACES, row["query"], row["max_results"]))
    for item, listed in passages.items():
        own = sorted(pairs[item])
        assert [q.split() for _, q, _ in own] == [[]] + [listed[i : i + 2] for i in range(len(listed))]
        assert [limit for _, _, limit in own[:4]] == [None, 1, 3, 2000]


def test_posts_without_a_thread_stay_searchable(spark, tables_of):
    posts, threads = tables_of
    asked = clauses.must_clauses(spark.createDataFrame([(1, "quick", None)], QUERIES))
    assert [p for _, p, _ in fresh(posts, threads.where("thread_id <> 1"), asked)] == [1, 2, 5]


def test_lookup_join_salting(spark):
    big = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k bigint, v string")
    plain = rows_of(joins.lookup_join(big, small, ["k"], "id", True))
    assert rows_of(joins.lookup_join(big, small, ["k"], "id", False)) == plain
    assert len(plain) == 1500


@pytest.mark.parametrize("cells, pairs", [(1 << 20, 1 << 21), (7, 5), (1, 1)])
def test_matches_of_one_group_against_brute_force(monkeypatch, cells, pairs):
    import pyarrow as pa

    monkeypatch.setattr(clauses, "_CELLS", cells)
    monkeypatch.setattr(clauses, "_PAIRS", pairs)
    draw = random.Random(4)
    # Units repeat for a post, as in two fields or two rows of one id; some dates are not known.
    held = [(f"w {draw.randint(0, 5)}", draw.randint(40, 50), draw.choice([None, 5, 9]), draw.random()) for _ in range(80)]
    asked, expected = [], {}
    for query in range(60):
        kinds = [draw.choice(["must", "must", "should", "must_not"]) for _ in range(draw.randint(1, 3))]
        listed = [(kind, f"w {draw.randint(0, 7)}") for kind in kinds]
        needed = kinds.count("must")
        bits = iter(range(3))
        asked += [(query, unit, kind, next(bits) if kind == "must" else -1, needed) for kind, unit in listed]
        for post in {row[1] for row in held}:
            own = [[row for row in held if row[1] == post and row[0] == unit] for _, unit in listed]
            met = sum(bool(rows) for (kind, _), rows in zip(listed, own) if kind == "must")
            optional = any(rows for (kind, _), rows in zip(listed, own) if kind == "should")
            forbidden = any(rows for (kind, _), rows in zip(listed, own) if kind == "must_not")
            if met == needed and not forbidden and (needed or optional):
                dates = [row[2] for rows in own for row in rows if row[2] is not None]
                weight = sum(row[3] for (kind, _), rows in zip(listed, own) if kind != "must_not" for row in rows)
                expected[query, post] = (max(dates, default=None), round(weight, 9))

    def table(names, rows):
        return pa.table({name: list(column) for name, column in zip(names, zip(*rows))})

    found = clauses.matches_of_group(
        table(["unit", "post_id", "date", "weight"], held), table(["query_id", "unit", "kind", "bit", "needed"], asked)
    ).to_pylist()
    assert {(r["query_id"], r["post_id"]): (r["date"], round(r["relevance"], 9)) for r in found} == expected
    assert len(found) == len(expected) > 50


def test_pairs_of_query_and_posting_do_not_shuffle(spark):
    posts = spark.createDataFrame([(i, 1, f"one two w{i % 3}", i) for i in range(40)], "post_id long, thread_id long, message string, post_date long")
    threads = spark.createDataFrame([(1, "two three")], "thread_id long, title string")
    queries = spark.createDataFrame([(1, "one two"), (2, "two w1")], "query_id long, query string")
    units = clauses.Units(clauses.must_clauses(queries))
    found = clauses.matches(clauses.index_for(posts, threads, units), units)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert not [line for line in plan.splitlines() if "hashpartitioning(query_id" in line and "post_id" in line]
    assert found.count() == 40 + len([i for i in range(40) if i % 3 == 1])


@pytest.mark.parametrize("chunk, phrases_of_slice", [(1 << 18, 1 << 17), (1, 3)])
def test_phrases_of_postings_against_brute_force(spark, monkeypatch, chunk, phrases_of_slice):
    monkeypatch.setattr(phrases, "CHUNK_POSTINGS", chunk)
    monkeypatch.setattr(phrases, "SLICE_PHRASES", phrases_of_slice)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000" if chunk > 1 else "7")
    posts, threads, draw, _ = drawn(spark, 60, 5, vocabulary=4)
    listed = sorted({" ".join(draw.choices(["w0", "w1", "w2", "w3", "stop", "absent"], k=1 + n % 6)) for n in range(90)})
    asked = spark.createDataFrame([(text, text.split()) for text in listed], "phrase string, words array<string>")
    found = phrases.standing(keyword_index.field_postings(posts, threads, 16), asked)
    expected = []
    for row in lexical.lexical_documents(posts, threads).collect():
        for field, text in enumerate((row["title"], row["message"])):
            for phrase in listed:
                if times := occurrences(phrase.split(), words(text)):
                    expected.append((phrase, row["post_id"] // 16, field, row["post_id"], row["date"], len(words(text)), times))
    columns = "phrase", "span", "field", "post_id", "date", "length", "times"
    got = rows_of(found, *columns)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(expected, key=repr) and len(expected) > 500


def test_pairs_of_phrase_and_posting_do_not_shuffle(spark, tmp_path):
    # All phrases begin with a word that every post has, and none stands in one: only postings may move, each once.
    posts = spark.createDataFrame([(i, 1, "u", "one two three", i) for i in range(64)], POSTS)
    threads = spark.createDataFrame([(1, "title", 0, 0)], THREADS)
    asked = spark.createDataFrame([(n, 0, "phrase", f"{a} {b} {c}") for n, (a, b, c) in enumerate([("one", "three", "two"), ("two", "one", "three"), ("three", "two", "one")] * 20)], CLAUSES)
    units = clauses.Units(asked)
    search_of = clauses.Search(clauses.index_for(posts, threads, units, 16), units)
    assert search_of.spans().count() == 0  # before, every span that holds the words was looked at
    assert fresh(posts, threads, asked, 16) == []


def test_no_score_in_a_span_is_above_its_bound(spark):
    posts, threads, draw, names = drawn(spark, 100, 6)
    listed = [(n, "should", word) for n in range(20) for word in draw.sample(names, 4)] + [(30, "must", "stop"), (30, "phrase", "stop w9")]
    asked = spark.createDataFrame([(q, i, kind, text) for i, (q, kind, text) in enumerate(listed)], CLAUSES)
    units = clauses.Units(asked)
    search_of = clauses.Search(clauses.index_for(posts, threads, units, 8), units)
    bounds = {(r["query_id"], r["span"]): r["bound"] for r in search_of.spans(F.lit(20_000)).collect()}
    dates = {r["post_id"]: r["post_date"] for r in posts.collect()}
    found = brute_force(lexical.lexical_documents(posts, threads), listed)
    assert found and all(score + 0.5 ** (abs(dates[post] - 20_000) / 864000) <= bounds[query, post // 8] + 1e-9 for query, post, score in found)


def test_pairs_of_query_and_block_do_not_shuffle(spark):
    posts, threads, _, _ = drawn(spark, 60, 7)
    units = clauses.Units(clauses.must_clauses(spark.createDataFrame([(n, f"stop w{n}", None) for n in range(20)], QUERIES)))
    plan = clauses.Search(clauses.index_for(posts, threads, units, 4), units).spans()._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line and "span" in line]


def test_an_index_cuts_texts_into_words_once_for_postings_and_once_for_lengths(spark, tmp_path):
    posts, threads = (rows.localCheckpoint() for rows in drawn(spark, 60, 5)[:2])
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    watched = F.udf(counted).asNondeterministic()
    index = keyword_index.add(posts.withColumn("message", watched("message")), threads, str(tmp_path / "watched"), 4, 8)
    assert seen.value == 2 * posts.count()
    plain = keyword_index.build(posts, threads, span=8)
    names = ["term", "field", "post_id", "positions", "span"]
    assert rows_of(index.postings, *names) == rows_of(plain.postings, *names)
    assert rows_of(index.blocks, *plain.blocks.columns) == rows_of(plain.blocks, *plain.blocks.columns)


def test_a_large_bucket_fills_many_files(spark, tmp_path):
    posts, threads, *_ = drawn(spark, 4000, 6)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        keyword_index.add(posts.repartition(8), threads, str(tmp_path / "index"), 1, 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for part in ("postings", "blocks"):
        assert len(list((tmp_path / "index" / part / "segment=0" / "bucket=0").glob("*.parquet"))) > 2


def most_rows_of_a_step(found):
    """The most rows that any step of a plan gave when it ran."""
    found.collect()
    nodes, most = [found._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inside = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else []
        below = node.children()
        nodes += [*inside, *[below.apply(i) for i in range(below.size())]]
    return most


@pytest.mark.parametrize("bound", [clauses.BROADCAST_ROWS, 1, -1])
def test_word_starts_do_not_meet_the_dictionary_once_for_each_span(spark, monkeypatch, bound):
    # 1,200 words of one start, each in one post, and 300 spans: before, every word was looked for in every span.
    posts = [(i, i % 40, "u", " ".join(f"wo{4 * i + j} other" for j in range(4)), i) for i in range(300)]
    posts = spark.createDataFrame([*posts, (300, 40, "u", "wound wound wo", None)], POSTS)
    threads = spark.createDataFrame([(i, f"Wo title{i}" if i % 2 else None, 0, 0) for i in range(41)], THREADS)
    asked = spark.createDataFrame([(1, 0, "prefix", "wo"), (2, 0, "prefix", "wo11"), (2, 1, "should", "other"), (3, 0, "prefix", "?"), (4, 0, "prefix", "w")], CLAUSES)
    listed = [(1, "prefix", "wo"), (2, "prefix", "wo11"), (2, "should", "other"), (3, "prefix", "?"), (4, "prefix", "w")]
    monkeypatch.setattr(clauses, "BROADCAST_ROWS", bound if bound < 0 else clauses.BROADCAST_ROWS)
    units = clauses.Units(asked)
    assert units.few == (bound > 0)
    search_of = clauses.Search(clauses.index_for(posts, threads, units, 1), units)
    spans = clauses.materialize(search_of.spans().select("query_id", "span"))
    monkeypatch.setattr(clauses, "BROADCAST_ROWS", bound)
    assert most_rows_of_a_step(search_of._prefix_hits(spans)[1]) < 25_000
    found = search_of.scores(spans).withColumn("relevance", F.round("relevance", 9))
    expected = brute_force(lexical.lexical_documents(posts, threads), listed)
    assert len(expected) > 600 and rows_of(found, "query_id", "post_id", "relevance") == expected
