import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from forumlens.operators import knn
from forumlens.operators.ranking import top_per_query

CORPUS = "vec_id bigint, post_id bigint, thread_id bigint, embedding array<float>"
QUERIES = "query_id bigint, embedding array<float>"


def frames(spark, vectors, queries, partitions=5):
    corpus = [(i, None if i % 5 == 4 else i + 1, i if i % 5 == 4 else None, v) for i, v in vectors]
    return (
        spark.createDataFrame(queries, QUERIES),
        spark.createDataFrame(corpus, CORPUS).repartition(partitions),
    )


def brute_force(vectors, queries, k, metric):
    out = []
    for query_id, q in queries:
        q = None if q is None else np.array(q, dtype=np.float32).astype(float)
        scored = []
        for vec_id, v in vectors:
            if v is None or q is None or len(v) != len(q):
                continue
            v = np.array(v, dtype=np.float32).astype(float)
            if metric == knn.L2:
                score = ((v - q) ** 2).sum()
            else:
                size = np.sqrt((v**2).sum()) * np.sqrt((q**2).sum())
                score = -(v @ q) / size if size > 0 else np.nan
            if np.isfinite(score):
                scored.append((round(score, 9), vec_id))
        out += [(query_id, rank + 1, vec_id) for rank, (_, vec_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", [knn.L2, knn.COSINE])
@pytest.mark.parametrize("grid", [False, True])
def test_equals_brute_force(spark, metric, grid):
    rng = np.random.default_rng(3)
    # Coordinates on a coarse grid make many exact ties.
    vectors = [(i, (rng.integers(-2, 3, size=6) / 2).tolist()) for i in range(400)]
    vectors += [(1000, None), (1001, [1.0, 2.0]), (1002, [float("nan")] * 6), (1003, [0.0] * 6)]
    queries = [(i, (rng.integers(-2, 3, size=6) / 2).tolist()) for i in range(23)] + [(99, None)]
    q, corpus = frames(spark, vectors, queries)
    limits = {"slice_queries": 5, "pivots": 20} if grid else {}
    hits = knn.nearest(q, corpus, 7, metric, **limits)
    assert rows_of(hits, "query_id", "rank", "vec_id") == brute_force(vectors, queries, 7, metric)


def test_a_third_of_the_corpus_is_one_vector(spark):
    rng = np.random.default_rng(5)
    copy = rng.normal(size=8).astype(np.float32).tolist()
    vectors = [(i, copy if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    queries = [(1, copy), (2, rng.normal(size=8).astype(np.float32).tolist())]
    q, corpus = frames(spark, vectors, queries)
    hits = knn.nearest(q, corpus, 10)
    assert rows_of(hits, "query_id", "rank", "vec_id") == brute_force(vectors, queries, 10, knn.L2)
    assert [r["vec_id"] for r in hits.where("query_id = 1").orderBy("rank").collect()] == list(range(0, 30, 3))


def test_blocks_inside_a_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(500)]
    block = knn.QueryBlock(np.arange(9), rng.normal(size=(9, 4)))
    monkeypatch.setattr(knn, "_BLOCK_SCORES", 90)
    monkeypatch.setattr(knn, "_EXACT_VALUES", 16)
    import pyarrow as pa

    best = knn._BestHits(block, 3, knn.L2, ["vec_id"])
    matrix = np.array([v for _, v in vectors], dtype=np.float32).astype(float)
    for start in range(0, 500, 130):
        payload = pa.table({"vec_id": [i for i, _ in vectors[start : start + 130]]})
        best.add(matrix[start : start + 130], payload, np.arange(9))
    found = sorted(zip(best.query.tolist(), best.rows.column("vec_id").to_pylist()))
    expected = []
    for number, q in enumerate(block.matrix):
        expected += [(number, int(i)) for i in np.argsort(((matrix - q) ** 2).sum(axis=1))[:3]]
    assert found == sorted(expected)


@pytest.mark.parametrize("metric", [knn.L2, knn.COSINE])
def test_slices_chunks_and_pivots_change_nothing(spark, monkeypatch, metric):
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    q, corpus = frames(spark, vectors, vectors[:40])
    expected = brute_force(vectors, vectors[:40], 4, metric)
    for values, chunk, pivots in ((1 << 22, 1 << 24, 512), (16, 80, 30), (64, 400, 2), (8, 8, 1)):
        monkeypatch.setattr(knn, "SLICE_VALUES", values)
        monkeypatch.setattr(knn, "CHUNK_VALUES", chunk)
        assert rows_of(knn.nearest(q, corpus, 4, metric, pivots=pivots), "query_id", "rank", "vec_id") == expected


@pytest.mark.parametrize("metric", [knn.L2, knn.COSINE])
def test_groups_out_of_reach_are_skipped(spark, metric):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 16)) * 10
    spread = [(centres[i % 12] + rng.normal(size=16) * 0.05).astype(np.float32).tolist() for i in range(1200)]
    vectors = list(enumerate(spread)) + [(2000 + i, spread[0]) for i in range(400)]  # a quarter are copies
    q, corpus = frames(spark, vectors, vectors[:60], partitions=3)
    scanned = knn.scan(q, corpus, 5, metric, ["vec_id"], 4096, 512)
    found = knn.ranked(scanned, 5, metric, ["vec_id"])
    assert rows_of(found, "query_id", "rank", "vec_id") == brute_force(vectors, vectors[:60], 5, metric)
    figures = knn.scanned_share(scanned).first()
    assert 0 < figures["compared"] < 0.3 * figures["pairs"]


def test_queries_do_not_reach_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rng = np.random.default_rng(11)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    q, corpus = frames(spark, vectors, vectors)
    taken = []
    to_arrow = Classic.toArrow
    monkeypatch.setattr(Classic, "toArrow", lambda self: taken.append(self.columns) or to_arrow(self))
    monkeypatch.setattr(knn, "SLICE_VALUES", 80)
    assert knn.nearest(q, corpus, 4).count() == 240
    assert taken == [["embedding"]]  # the pivots


def test_fewer_vectors_than_k(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    q, corpus = frames(spark, vectors, [(7, [1.0, 0.0])])
    assert rows_of(knn.nearest(q, corpus, 10), "rank", "vec_id", "distance") == [(1, 1, 0.0), (2, 2, 2.0)]


def test_empty_sides(spark):
    q, corpus = frames(spark, [(1, [1.0, 0.0])], [(7, [1.0, 0.0])])
    assert knn.nearest(q.where("false"), corpus, 3).count() == 0
    assert knn.nearest(q, corpus.where("false"), 3).count() == 0
    assert knn.nearest(q, corpus, 0).count() == 0


def test_top_k_is_a_prefix(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(200)]
    q, corpus = frames(spark, vectors, vectors[:3])
    whole = rows_of(knn.nearest(q, corpus, 200), "query_id", "rank", "vec_id")
    assert rows_of(knn.nearest(q, corpus, 9), "query_id", "rank", "vec_id") == [r for r in whole if r[1] <= 9]
    assert rows_of(knn.nearest(q, corpus, 200, scan_tasks=2), "query_id", "rank", "vec_id") == whole


def test_large_values_rank_exactly(spark):
    # Far from the origin the matrix product loses digits; the exact second step must not.
    vectors = [(i, [1.0e6 + i * 0.0625, 1.0e6]) for i in range(50)]
    q, corpus = frames(spark, vectors, [(1, [1.0e6 + 1.0, 1.0e6])])
    assert rows_of(knn.nearest(q, corpus, 5), "rank", "vec_id") == [(1, 16), (2, 15), (3, 17), (4, 14), (5, 18)]


@pytest.mark.parametrize("slice_rows", [2, 4096])
def test_mixed_lengths_get_their_own_answers(spark, slice_rows):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None)]
    queries = [(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.0, 0.1]), (4, [1.0]), (5, [])]
    q, corpus = frames(spark, vectors, queries)
    found = rows_of(knn.nearest(q, corpus, 3, slice_queries=slice_rows), "query_id", "rank", "vec_id")
    assert found == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 3)]


@pytest.mark.parametrize("k", [1, 1000, 5000])
def test_ranking_in_parts(spark, k):
    hits = spark.range(3000).select((F.col("id") % 2).alias("query_id"), "id", (F.col("id") % 7).alias("score"))
    ranked = top_per_query(hits, [F.col("score"), F.col("id")], k)
    expected = [
        (q, n + 1, i) for q in (0, 1) for n, (_, i) in enumerate(sorted((i % 7, i) for i in range(q, 3000, 2))[:k])
    ]
    assert sorted(rows_of(ranked, "query_id", "rank", "id")) == sorted(expected)


@pytest.mark.parametrize("metric", [knn.L2, knn.COSINE])
def test_vectors_without_clusters_are_compared_in_whole_blocks(monkeypatch, metric):
    import pyarrow as pa

    rng = np.random.default_rng(12)
    matrix = rng.normal(size=(700, 32))
    matrix /= np.sqrt((matrix**2).sum(axis=1))[:, None]
    monkeypatch.setattr(knn, "_BLOCK_SCORES", 200 * 60)
    sizes = []
    add = knn._BestHits._add_block
    monkeypatch.setattr(knn._BestHits, "_add_block", lambda self, v, p, a: sizes.append((len(v), len(a))) or add(self, v, p, a))
    chunk = knn._Chunk.of(matrix, pa.table({"vec_id": np.arange(700)}), knn.Pivots(matrix[:300]))
    best, pairs, compared = chunk.search(knn.QueryBlock(np.arange(60), matrix[-60:]), 4, metric, ["vec_id"])
    assert sizes == [(175, 60)] * 4 and pairs == compared
    found = sorted(zip(best.query.tolist(), best.rows.column("vec_id").to_pylist()))
    assert found == sorted((i, int(v)) for i in range(60) for v in np.argsort(-(matrix @ matrix[640 + i]))[:4])


def test_no_more_scan_tasks_than_run_at_once(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vectors = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    q, corpus = frames(spark, vectors, vectors[:10], partitions=100)
    parts = []
    scan = knn.scan
    monkeypatch.setattr(knn, "scan", lambda *a: parts.append(a[1].rdd.getNumPartitions()) or scan(*a))
    assert knn.nearest(q, corpus, 3).count() == 30
    assert parts[0] <= spark.sparkContext.defaultParallelism
