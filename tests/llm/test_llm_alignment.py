"""Alignment of two tokenizers against whole-text tokenization, and the perfect hash behind its counts."""

import hashlib
import itertools
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from forumlens.llm import alignment, perfect_hash, queries, spaced_words
from forumlens.sources.tables import read_parquet

SMALL = "/root/testdata/sf0.001"
FILES = alignment.Tokenizers(*map(queries.tokenizer_path, (queries.TOKENIZER, queries.RANKS, queries.PIECES)))
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD = [
    " a", "a ", "a  b", "a   b   c", "\n x", "x\n y", "x\n \ny\t z", "\n \n", "▁x y", "x ▁ y", "<s> <|endoftext|> </s> <0x41>",
    "é é ﬁ 日本 語 🎉 🎉🎉", "a　 b 　c", "a\xa0 b \xa0 c", " ", "  ", "\x00 \x00a \x1f b", "don't  we'll 'S 12.5 ½ x² ɏ ɐ",
    "a" * 5000, "word " * 3000, "", None, "ab​ cd ​ ef", "Привет мир, как дела", "x ", "\r\n \r\n y", "same text", "same text",
]


def brute_force(texts):
    """Figures of every text from tokens of the whole text, and the pairs of all links."""
    first = Tokenizer.from_file(FILES.merges)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES.pieces)
    spelled = spaced_words.visible_bytes()
    names = {number: token for token, number in first.get_vocab(False).items()}

    def second_bytes(number):
        piece = second.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(number) else piece.replace("▁", " ").encode()

    found, links = {}, {}
    for key, text in texts.items():
        found[key], links[key] = (0, 0, 0, 0, ""), []
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a_bytes, b_bytes = [bytes(spelled[c] for c in names[i]) for i in a], [second_bytes(i) for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            continue
        a_ends, b_ends = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        i = j = group_i = group_j = 0
        groups = []
        while i < len(a):
            links[key].append((a[i], b[j]))
            ends = a_ends[i], b_ends[j]
            i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
            if ends[0] == ends[1]:
                groups.append(",".join(map(str, a[group_i:i])) + "|" + ",".join(map(str, b[group_j:j])))
                group_i, group_j = i, j
        found[key] = (len(a), len(b), len(groups), len(links[key]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(pair for listed in links.values() for pair in listed)
    highest = defaultdict(int)
    for (_, b), count in counts.items():
        highest[b] = max(highest[b], count)
    return {
        key: (*f[:4], sum(counts[p] == highest[p[1]] for p in links[key]), sum(counts[p] for p in links[key]), f[4])
        for key, f in found.items()
    }


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 5])
def test_alignment_equals_brute_force(spark, broadcast_pairs):
    documents = read_parquet(spark, SMALL, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(9000 + n, text) for n, text in enumerate(ODD)], "doc_id long, text string")
    documents = documents.unionByName(odd).repartition(5)
    clashing = documents.select("*", *[F.lit("x").alias(n) for n in ("key", "n", "row", "count", "best", "segment", "pairs", "n_a")])
    expected = brute_force({row.doc_id: row.text for row in documents.collect()})
    found = alignment.align(clashing, FILES, broadcast_pairs=broadcast_pairs)
    assert found.columns == ["doc_id", *NAMES]
    rows = found.collect()
    assert len(rows) == len(expected)
    assert {row.doc_id: tuple(row[name] for name in NAMES) for row in rows} == expected


def test_query_equals_brute_force(spark):
    texts = {row.doc_id: row.text for row in read_parquet(spark, SMALL, "documents").collect()}
    found = {row.doc_id: tuple(row[n] for n in NAMES) for row in entry_points.queries()["op13_alignment"](spark, SMALL).collect()}
    assert found == brute_force(texts)


def test_no_rows_and_no_texts(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), FILES).collect() == []
    for bound in (alignment.BROADCAST_PAIRS, -1):
        rows = alignment.align(spark.createDataFrame([(1, None), (1, None), (None, "")], schema), FILES, broadcast_pairs=bound).collect()
        assert [tuple(row)[1:] for row in rows] == [(0, 0, 0, 0, 0, 0, "")] * 3
        assert sorted((row.doc_id for row in rows), key=str) == [1, 1, None]


def test_repeated_keys_count_each(spark):
    rows = [(1, "two words"), (1, "two words"), (None, "words"), (2, "two")]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), FILES).collect()
    expected = brute_force(dict(enumerate(text for _, text in rows)))
    assert sorted(tuple(row)[1:] for row in found) == sorted(expected.values())


def test_what_a_worker_remembers_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_KEPT", 2000)
    monkeypatch.setattr(alignment, "_BYTES_AT_ONCE", 200)
    parts = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
    texts = [f"number {n} of many texts, {n * n}".encode() for n in range(50)]
    for portion in alignment._portions(texts):
        if parts.full:
            parts.forget()
        numbers, starts = parts.number(texts[portion])
        assert len(starts) == portion.stop - portion.start
        assert parts.held < 20_000
        written = [b";".join(parts.groups[n] for n in own) for own in np.split(numbers, starts[1:])]
        whole = AlignedWhole(texts[portion])
        assert written == whole.groups


class AlignedWhole:
    def __init__(self, texts):
        figures = brute_force({place: text.decode() for place, text in enumerate(texts)})
        parts = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
        self.groups = []
        for place, text in enumerate(texts):
            numbers, _ = parts.number([text])
            self.groups.append(b";".join(parts.groups[n] for n in numbers))
            assert hashlib.sha256(self.groups[-1]).hexdigest() == figures[place][6]


def test_both_libraries_agree_on_the_vocabulary():
    parts = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
    words = [b[1:].decode() for b in parts.first_bytes.values() if b.isascii() and b[:1] == b" " and b.strip()]
    plain, _ = parts.first.sorted_out(words)
    assert len(plain) > 25_000
    whole = [encoding.ids for encoding in parts.first.whole.encode_batch([" " + word for word in plain], add_special_tokens=False)]
    again, ids, counts = parts.first.ids(plain)
    assert again == plain
    assert [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])] == whole


@pytest.mark.parametrize("count, segments", [(0, 1), (1, 1), (64, 4), (50_000, 8)])
def test_perfect_hash_is_minimal_and_verified(count, segments):
    keys = np.unique(np.random.default_rng(count).integers(-(1 << 62), 1 << 62, count))
    dealt = perfect_hash.segment_of(keys, segments)
    found = perfect_hash.PerfectHash([perfect_hash.build_segment(keys[dealt == number]) for number in range(segments)])
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    strangers = np.setdiff1d(keys + 1, keys)
    assert (found.slots(strangers) == -1).all()
    assert count < 1000 or len(found.words) * 64 < 4 * count


def test_perfect_hash_built_by_spark(spark):
    keys = spark.range(10_000).select((F.col("id") * 977 - 5_000_000).alias("key")).repartition(5)
    rows = perfect_hash.build(keys, 4)
    assert rows.count() == 4
    found = perfect_hash.load(rows.toArrow(), 4)
    slots = found.slots(np.arange(10_000) * 977 - 5_000_000)
    assert sorted(slots.tolist()) == list(range(10_000))
    with pytest.raises(ValueError):
        perfect_hash.build_segment(np.array([1, 2, 2]))


def test_dense_sums_equal_sums(spark):
    rows = [(key * key % 101, key % 7 + 1) for key in range(3000)]
    counts = spark.createDataFrame(rows, "key long, n long").repartition(12)
    distinct = counts.select("key").distinct()
    expected = Counter()
    for key, n in rows:
        expected[key] += n
    for segments, fan in ((1, 2), (4, 3)):
        sums = alignment.dense_sums(counts, perfect_hash.build(distinct, segments), segments, 12, fan)
        assert {row.key: row["count"] for row in sums.collect()} == expected


def test_groups_are_written_without_a_step_for_each():
    """Calls from Python, as a profiler sees them, stay below the groups."""
    parts = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
    words = [f"{a}{b}x{n}" for n, (a, b) in enumerate(itertools.product(("un", "Straße", "日", "w"), ("able", "é", "🎉", "ing")))] * 200
    words, first, _ = parts.first.ids(words)
    second = np.array([i for ids in parts.second.encode(words) for i in ids])
    ends = np.cumsum([len(word.encode()) + 1 for word in words])
    calls = Counter()
    sys.setprofile(lambda frame, event, called: calls.update([event]))
    try:
        counts, groups, _, _ = parts._aligned(first, second, ends, np.ones(len(words), bool))
    finally:
        sys.setprofile(None)
    assert len(groups) == len(words) and sum(counts[:, 2]) == sum(len(one.split(b";")) for one in groups) > 2 * len(words)
    assert calls["c_call"] < len(words) / 4


def test_parts_without_groups_and_new_parts_of_any_kind():
    parts = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
    numbers, starts = parts.number(["▁ ▁".encode()])
    assert not parts.good[numbers].all() and parts.groups[numbers[~parts.good[numbers]][0]] == b"" and starts.tolist() == [0]
    texts = ["ab 日本 cd ab", "日本 ef ▁x cd", "ef"]
    numbers, starts = parts.number([text.encode() for text in texts])
    flat = [word for text in texts for word in text.split(" ")]
    assert starts.tolist() == [0, 4, 8] and [list(parts.numbers)[n] for n in range(len(parts))] != flat
    for word, number in zip(flat, numbers):
        alone = alignment.AlignedParts(FILES.merges, FILES.ranks, FILES.pieces)
        own, _ = alone.number([word.encode()])
        assert parts.groups[number] == alone.groups[own[0]] and parts.counts[number].tolist() == alone.counts[own[0]].tolist()
