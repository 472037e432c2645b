"""The pipeline, stage by stage, against brute force on whole small tables."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from forumlens.sources.tables import read_parquet

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark):
    documents = read_parquet(spark, SMALL, "documents")
    noise = spark.createDataFrame([(9001, "12 34 !!", "en"), (9002, None, "en")], "doc_id long, text string, lang string")
    documents = documents.unionByName(noise, allowMissingColumns=True)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        documents = corpus_pipeline.materialize(stage(spark, documents, SMALL))
        kept[name] = {row.doc_id for row in documents.select("doc_id").collect()}
        if name != "packing":
            assert documents.columns == read_parquet(spark, SMALL, "documents").columns
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    assert kept["language"] == set(texts)

    sets = {doc_id: shingles(text) for doc_id, text in texts.items()}
    stay = kept["near_duplicates"]
    for a in texts:
        near = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in texts if b < a]
        if max(near, default=0) < 0.5:
            assert a in stay
        if max(near, default=0) >= 0.9:
            assert a not in stay

    contaminated = {
        row.doc_id
        for row in corpus_pipeline.decontamination.scan(
            read_parquet(spark, SMALL, "documents"), read_parquet(spark, SMALL, "benchmark"), ["doc_id"]
        ).where("n_hit > 0").select("source.doc_id").collect()
    }
    assert kept["decontamination"] == stay - contaminated
    assert kept["packing"] == kept["decontamination"]
    assert documents.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    ]


def test_near_duplicates_are_those_of_the_exact_similarity(spark):
    # A pair of sets of 300 shingles and more: the words at the end differ, 5 words before them tie the rest together.
    rows, expected = [], set()
    for number, (common, own) in enumerate([(320, 80), (330, 72), (340, 60), (312, 84), (300, 88), (300, 100)] * 60):
        head = [f"w{number}x{i}" for i in range(common + 4)]
        for copy in range(2):
            tail = [f"c{copy}n{number}x{i}" for i in range(own // 2)]
            rows.append((2 * number + copy, " ".join([*head, *tail])))
        expected.add(2 * number)
        if common / (common + 2 * (own // 2)) < 0.8:
            expected.add(2 * number + 1)
    # Two texts that share only a passage which one of them repeats, and a blank text.
    passage = "one two three four five six "
    rows += [(9000, passage * 80 + " ".join(f"p{i}" for i in range(400))), (9001, passage * 80 + " ".join(f"q{i}" for i in range(400)))]
    documents = spark.createDataFrame([*rows, (9002, "")], "doc_id long, text string").repartition(8)
    kept = {row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, documents, SMALL).collect()}
    assert kept == expected | {9000, 9001, 9002}


def test_chains_of_near_duplicates_leave_one(spark):
    # Neighbours have a similarity above 0.8, the ends of the chain have nothing in common.
    rows = [(i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 200))) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, documents, SMALL).collect()]
    assert kept == [0]


def kept_rows(spark, rows, extra=()):
    documents = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(n) for n in extra])
    found = corpus_pipeline.drop_near_duplicates(spark, documents.repartition(3), SMALL)
    assert found.columns == documents.columns
    return sorted(((row.doc_id, row.text) for row in found.collect()), key=repr)


def test_rows_go_by_what_they_say(spark):
    a, b, c, d = (" ".join(f"{letter}{i}" for i in range(40)) for letter in "abcd")
    assert kept_rows(spark, [(1, a), (None, a), (None, d), (None, c)]) == sorted([(1, a), (None, d), (None, c)], key=repr)
    assert kept_rows(spark, [(3, c), (5, c), (5, d)]) == [(3, c), (5, d)]
    assert kept_rows(spark, [(8, a), (8, a), (8, b)]) == [(8, a), (8, b)]
    assert kept_rows(spark, [(None, a), (None, a)]) == [(None, a)]
    assert kept_rows(spark, [(4, None), (2, ""), (9, " \n")]) == [(2, "")]
    assert kept_rows(spark, []) == []
    names = ("row", "row_0", "row_1", "node", "digest", "n", "minima", "bucket", "family", "label", "first", "gone", "stays", "component_id")
    assert kept_rows(spark, [(1, a), (2, a), (3, b)], names) == [(1, a), (3, b)]


def test_families_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.jaccard, "BUCKET_CHUNK", 4)
    monkeypatch.setattr(corpus_pipeline.jaccard, "FAMILY_CHUNK", 3)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for number in range(40):  # near copies of one text, some near each other and some not
        words = list(base)
        for place in draw.sample(range(200), draw.randint(0, 9)):
            words[place] = f"n{number}p{place}"
        rows.append((number, " ".join(words)))
    sets = {number: shingles(text) for number, text in rows}
    group = {number: number for number, _ in rows}
    for _ in rows:
        for a in sets:
            near = [group[b] for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            group[a] = min(near)
    assert {doc_id for doc_id, _ in kept_rows(spark, rows)} == set(group.values())


def test_common_sizes():
    draw = np.random.default_rng(2)
    lists = [np.unique(draw.integers(0, 60, size).astype(np.uint64)) for size in (0, 5, 30, 30, 80)]
    assert (corpus_pipeline.jaccard.common_sizes(lists) == [[len(np.intersect1d(a, b)) * (a is not b) or
            (0 if a is not b else len(np.intersect1d(a, np.concatenate([o for o in lists if o is not a])))) for b in lists] for a in lists]).all()


def test_language_stage_follows_the_profiles(spark):
    documents = read_parquet(spark, SMALL, "documents")
    schema = "doc_id long, text string, lang string"
    foreign = "Съешь же ещё этих мягких французских булок, да выпей чаю"
    more = [(9001, foreign, None), (9002, foreign * 30, None), (9003, "A.", None), (9004, "2 + 2", None), (9005, "Withthesones", None)]
    more = spark.createDataFrame(more, schema)
    kept = corpus_pipeline.identify_language(spark, documents.unionByName(more, allowMissingColumns=True), SMALL)
    known = {row.doc_id for row in documents.select("doc_id").collect()}
    assert {row.doc_id for row in kept.select("doc_id").collect()} == known | {9003, 9005}
    # A language that has labelled rows is known.
    labelled = spark.createDataFrame([(9100 + i, foreign, "ru") for i in range(20)], schema)
    documents = documents.unionByName(more, allowMissingColumns=True).unionByName(labelled, allowMissingColumns=True)
    kept = {row.doc_id for row in corpus_pipeline.identify_language(spark, documents, SMALL).select("doc_id").collect()}
    assert kept >= {9001, 9002, *range(9100, 9120)}


def test_language_stage_without_labels_keeps_letters(spark):
    rows = [(1, "some text", None), (2, "12 !", None), (3, None, None), (4, "Größe", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {row.doc_id for row in corpus_pipeline.identify_language(spark, documents, SMALL).collect()} == {1, 4}


def test_simhash_finds_candidates_and_the_similarity_decides(spark, monkeypatch):
    # Without buckets of minimum hashes only SimHash is left to find the pairs.
    buckets = corpus_pipeline.jaccard._buckets
    monkeypatch.setattr(corpus_pipeline.jaccard, "_buckets", lambda nodes: buckets(nodes).where("false"))
    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(f"o{i}" for i in range(600)))]
    # A passage that one text repeats far more often than the other: like fingerprints, but sets that have little in common.
    passage = " ".join(words[:21])
    rows += [(n, " ".join([passage] * 60 + [f"{n}x{i}" for i in range(25)])) for n in (4, 5)]
    documents = spark.createDataFrame([*rows, (6, ""), (7, None)], "doc_id long, text string")
    close = {row.doc_id: row.component_id for row in corpus_pipeline.simhash.near_duplicates(documents).collect()}
    assert close[2] == close[1] and close[5] == close[4]
    kept = {row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, documents, SMALL).collect()}
    assert kept == {1, 3, 4, 5, 6}


def test_vectors_of_many_texts_take_little_memory():
    import tracemalloc

    from forumlens.llm import language

    draw = random.Random(5)
    texts = ["".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(60)) for _ in range(400)]
    encoder = language._Encoder()
    one_by_one = np.vstack([encoder.vectors([text]) for text in texts])
    tracemalloc.start()
    found = encoder.vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == one_by_one).all()
    assert peak < 40 << 20


def test_what_is_usual_is_learnt_from_all_labelled_texts(spark):
    from forumlens.llm import language

    # More texts of one label than train its profile; 40 of them have few letters of the others.
    draw = random.Random(11)
    drawn = lambda letters, words: " ".join("".join(draw.choices(letters, k=5)) for _ in range(words))
    rows = [(n, drawn("abcd", 1 if n % 300 == 7 else 6) + " " + drawn("жзийклмнопрст", 12 * (n % 300 == 7)), "en") for n in range(12_000)]
    rows += [(12_000, "12 3", "en"), (12_001, None, "en"), (12_002, "щщ", "en")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    found = language.predict(documents, language.train(documents), ["doc_id", "text"]).collect()
    telling = [(row.score, row.source.doc_id) for row in found if row.source.doc_id < 12_000]
    least = sorted(telling)[11][0]  # a thousandth of 12,000 texts is 12
    assert 0 < least < language.CHANCE
    dropped = {doc_id for score, doc_id in telling if score < least}
    assert len(dropped) == 11
    kept = {row.doc_id for row in corpus_pipeline.identify_language(spark, documents, SMALL).select("doc_id").collect()}
    assert kept == {*range(12_000), 12_002} - dropped


def test_enough_letters(spark):
    from forumlens.llm import language

    texts = ["", "a" * 19, "a" * 20, "1 a\n" * 19, "1 a\n" * 20, "\U00010400" * 19, "\U00010400" * 20, "?" * 50_000 + "b" * 20, ("?" * 5_000 + "b") * 19 + "?" * 50_000, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").orderBy("n")
    telling = [row[0] for row in frame.select(language._telling(F.col("text"))).collect()]
    assert telling == [None if text is None else sum(c.isalpha() for c in text) >= 20 for text in texts]
