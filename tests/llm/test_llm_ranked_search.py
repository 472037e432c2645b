"""Ranked search against scores of all documents, and what its blocks skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.llm import ranked_search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(documents, items, results=20):
    counted = [(key, Counter(words(text))) for key, text in documents if words(text)]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    holding = Counter(term for _, c in counted for term in c)
    found = []
    for item, text in items:
        scores = []
        for key, counts in counted:
            n = sum(counts.values())
            size = 100 - 25 + (25 * n * total) // length
            score = 0
            for term in words(text):
                if counts[term]:
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * holding[term] + 1)))
                    score += weight * ((1000000000 * counts[term]) // (1000 * counts[term] + 12 * size))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        scores.sort(key=lambda s: s[:3])
        found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(scores[:results], 1)]
    return sorted(found, key=repr)


def searched(spark, documents, items, **options):
    documents = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    clashing = [F.lit("x").alias(n) for n in ("item", "key", "terms", "times", "n", "document", "score", "rank", "asked_key")]
    found = ranked_search.search(documents.select("*", *clashing), items.select("*", *clashing), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(row) for row in found.collect()), key=repr)


def drawn(seed, count, longest=60):
    draw = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    return [(i, " ".join(draw.choices(common + rare, [30] * 12 + [1] * 300, k=draw.randint(1, longest)))) for i in range(count)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 5)
    monkeypatch.setattr(ranked_search, "FEW", 2)
    documents = drawn(1, 400) + [(1000 + i, "c0 c1 r7 r8") for i in range(60)]
    documents += [(2000, " ".join(f"r{i} c{i % 12}" for i in range(300))), (2001, "c0 " * 50_000 + "r9")]
    items = drawn(2, 25, 30) + [(90, "r7 R7 r8 zzz"), (91, "unknown"), (92, "c0")]
    expected = brute_force(documents, items)
    assert searched(spark, documents, items) == expected
    # Few entries at a time: several passes over the documents give the same.
    assert searched(spark, documents, items, query_entries=200) == expected
    assert searched(spark, documents, items, results=3) == brute_force(documents, items, 3)


def test_odd_rows(spark):
    documents = [
        (1, None), (2, ""), (3, "... !"), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (6, "Straße ÉTÉ été 日本語 word"),
        (7, "x" * 100_000 + " word"), (-3, "word"),
    ]
    items = [(1, "word"), (1, "word"), (None, "été word"), (2, None), (3, "-"), (4, "STRASSE straße 日本語")]
    assert searched(spark, documents, items) == brute_force(documents, items)
    assert searched(spark, [], items) == [] and searched(spark, documents, []) == []
    assert searched(spark, [(1, None)], items) == []


def shard_of(documents, asked):
    weights = np.array([100 + 7 * n for n in range(len(asked))], np.int64)
    places = {term: n for n, term in enumerate(asked)}
    corpus = ranked_search.Corpus(len(documents), sum(len(words(t)) for _, t in documents))
    counts = [sorted((places[t], c) for t, c in Counter(words(text)).items() if t in places) for _, text in documents]
    sizes = np.array([len(c) for c in counts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms, times = (np.array([pair[i] for c in counts for pair in c], np.int64) for i in range(2))
    n = np.repeat([len(words(t)) for _, t in documents], sizes)
    impacts = corpus.impacts(times, n)
    return ranked_search.build_shard(np.array([k for k, _ in documents]), starts, terms, impacts, weights), weights


@pytest.mark.parametrize("wide", [512, 8])
def test_summaries_bound_every_document_of_their_block(monkeypatch, wide):
    monkeypatch.setattr(ranked_search, "WIDE", wide)
    monkeypatch.setattr(ranked_search, "BLOCK", 6)
    monkeypatch.setattr(ranked_search, "FEW", 3)
    monkeypatch.setattr(ranked_search, "_AT_ONCE", 100)
    documents = drawn(3, 300)
    asked = sorted({t for _, text in documents for t in words(text)})
    shard, weights = shard_of(documents, asked)
    every = shard.scores(np.arange(300), weights)
    summaries = {}
    for term, block, impact in zip(shard.summary_terms, shard.summary_blocks, shard.summary_impacts):
        summaries[int(block), int(term)] = int(impact)
    listed = {(int(t), int(b)) for t, b in zip(shard.list_terms, shard.list_blocks)}
    for document in range(300):
        own = slice(shard.document_starts[document], shard.document_starts[document + 1])
        for term in shard.terms[own]:  # every document is in a block of each of its lists
            assert any(
                document in shard.members[shard.member_starts[b] : shard.member_starts[b + 1]] for t, b in listed if t == term
            )
    for block in range(len(shard.member_starts) - 1):
        members = shard.members[shard.member_starts[block] : shard.member_starts[block + 1]]
        largest = Counter()
        for document in members:
            own = slice(shard.document_starts[document], shard.document_starts[document + 1])
            for term, impact in zip(shard.terms[own], shard.impacts[own]):
                largest[int(term)] = max(largest[int(term)], int(impact))
        if block < shard.unbounded[0]:
            assert not any(b == block for b, _ in summaries) and len(members) <= 3
            continue
        assert {(block, t): i for t, i in largest.items()} == {k: v for k, v in summaries.items() if k[0] == block}
        bound = sum(weights[t] * i for t, i in largest.items())
        assert (every[members] <= bound).all()


def test_blocks_are_skipped_and_nothing_is_lost():
    draw = random.Random(5)
    # Twenty subjects with words of their own, and a word that every document has.
    documents = [(i, " ".join(["the"] + draw.choices([f"s{i % 20}w{j}" for j in range(15)], k=12))) for i in range(2000)]
    asked = sorted({t for _, text in documents for t in words(text)})
    shard, weights = shard_of(documents, asked)
    places = {term: n for n, term in enumerate(asked)}
    chosen = np.array(sorted(places[t] for t in ("the", "s3w1", "s3w2", "s3w4")))
    best = ranked_search.Best([ranked_search.Query(0, chosen, weights[chosen])], 10, len(asked))
    best.add(shard)
    assert best.read < 0.5 * best.blocks
    only = np.zeros(len(asked), np.int64)
    only[chosen] = weights[chosen]
    scores = shard.scores(np.arange(2000), only)
    expected = sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:10]
    assert sorted(best.found[0], reverse=True) == expected


def test_shards_are_bounded(spark, monkeypatch):
    documents = drawn(7, 200)
    vocabulary = sorted({t.encode() for _, text in documents for t in words(text)})
    frame = spark.createDataFrame(documents, "doc_id long, text string").coalesce(1)
    rows = ranked_search.vectors(frame, vocabulary, "doc_id", "text")
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", 32)
    monkeypatch.setattr(ranked_search, "SHARD_ENTRIES", 300)
    shipped = ranked_search.build_index(rows, ranked_search.Corpus(200, 6000), np.ones(len(vocabulary), np.int64))
    sizes = shipped.select(F.size("documents").alias("d"), F.size("terms").alias("t")).collect()
    assert sum(row.d for row in sizes) == 200
