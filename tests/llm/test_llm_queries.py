"""Every query of the subpackage against SQL or a brute-force version on whole small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import pytest
import xxhash
from helpers import plain
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from forumlens.llm import fingerprints, oracle, queries

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def table(name, directory=SMALL):
    found = duckdb.sql(f"SELECT * FROM '{directory}/{name}.parquet'")
    return [dict(zip(found.columns, row)) for row in found.fetchall()]


def rows(spark, name, directory=SMALL):
    return entry_points.queries()[name](spark, directory).collect()


def test_one_query_for_each_operator():
    names = [re.match(r"op(\d+)_", name)[1] for name in queries.all_queries()]
    assert sorted(map(int, names)) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", sorted(oracle.all_oracles()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for part in ("conversations", "documents", "benchmark", "pages"):
        connection.sql(f"CREATE VIEW {part} AS SELECT * FROM '{SF}/{part}.parquet'")
    answer = connection.execute(entry_points.oracle_sql()[name])
    kinds = {column[0]: str(column[1]) for column in answer.description}
    frame = entry_points.queries()[name](spark, SF)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema} == kinds
    names = sorted(frame.columns)
    places = [[c[0] for c in answer.description].index(n) for n in names]
    expected = sorted((tuple(plain(row[i]) for i in places) for row in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(row[n]) for n in names) for row in frame.collect()), key=repr) == expected


def test_op1_equals_brute_force(spark):
    def best(key, shards):
        return max(range(shards), key=lambda s: (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16), -s))

    texts = {row["doc_id"]: (row["text"] or "").encode() for row in table("documents")}
    found = rows(spark, "op1_rendezvous")
    assert sorted(row.doc_id for row in found) == sorted(texts)
    slots = defaultdict(list)
    for row in found:
        text = texts[row.doc_id]
        assert (row.size, row.text_crc32, row.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert (row.shard, row.grown_shard) == (best(row.doc_id, 16), best(row.doc_id, 17))
        assert row.grown_shard in (row.shard, 16)
        slots[row.shard].append(row.slot)
    assert all(sorted(listed) == list(range(len(listed))) for listed in slots.values())


def test_op2_keeps_the_article(spark):
    def article(html):
        inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        texts = (re.sub(r"<br>|</?b>", " ", part) for part in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(text for text in (" ".join(unescape(t).split()) for t in texts) if text)

    expected = {row["page_id"]: article(row["html"]) for row in table("pages", SF)}
    found = rows(spark, "op2_extraction", SF)
    assert {row.page_id: row.text for row in found} == expected
    assert all(row.n_chars == len(row.text) for row in found)


def test_op3_packs_all_ids(spark):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {row["doc_id"]: [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2] for row in table("documents")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows(spark, "op3_packing"):
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append((row.offset, row.length))
    assert set(pieces) == set(ids)
    for doc_id, listed in pieces.items():
        listed.sort(key=lambda row: row.piece)
        at = 0
        for number, row in enumerate(listed):
            part = ids[doc_id][at : at + row.length]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert (row.piece, row.start, row.ids_crc32) == (number, at, crc)
            assert row.length == 1024 or number == 0
            at += row.length
        assert at == len(ids[doc_id])
    for listed in sequences.values():
        at = 0
        for offset, length in sorted(listed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 1024 * 1.02) + 1


def test_op4_reads_back_what_it_wrote(spark):
    pages = {row["page_id"]: (row["html"] or "").encode() for row in table("pages")}
    largest = {}
    for page, payload in sorted(pages.items()):
        largest[payload] = page
    for row in rows(spark, "op4_warc"):
        payload = pages.pop(row.page_id)
        first = largest[payload]
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (row.record_type, row.refers_to) == (("response", None) if first == row.page_id else ("revisit", first))
    assert not pages


def shingles(text, size):
    words = text.lower().split()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def jaccard(left, right):
    both = set(left) | set(right)
    return sum(min(left[t], right[t]) for t in both) / sum(max(left[t], right[t]) for t in both) if both else 1.0


def test_op6_estimates_the_generalised_jaccard_similarity(spark):
    texts = {row["doc_id"]: row["text"] or "" for row in table("documents")}
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    found = rows(spark, "op6_fingerprints")
    assert sorted(row.doc_id for row in found) == ids
    prints, errors = {}, []
    for row in found:
        text, other = texts[row.doc_id], texts[after[row.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        errors.append(row.near_edited - jaccard(shingles(text, 5), shingles(edited, 5)))
        errors.append(row.near_next - jaccard(shingles(text, 5), shingles(other, 5)))
    assert len({row.fingerprint for row in found}) > 0.8 * len(texts)
    assert abs(sum(errors) / len(errors)) < 0.02  # the estimate has no bias
    assert max(map(abs, errors)) < 0.6


def test_op6_errors_stay_within_four_standard_errors(spark):
    texts = {row["doc_id"]: row["text"] or "" for row in table("documents")}
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    for row in rows(spark, "op6_fingerprints"):
        text, other = texts[row.doc_id], texts[after[row.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert len(row.fingerprint) == fingerprints.SAMPLES * 8
        assert abs(row.near_edited - jaccard(shingles(text, 5), shingles(edited, 5))) < 4 * 0.5 / fingerprints.SAMPLES**0.5
        assert abs(row.near_next - jaccard(shingles(text, 5), shingles(other, 5))) < 4 * 0.5 / fingerprints.SAMPLES**0.5


def test_op7_equals_brute_force(spark):
    def fingerprint(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0d]+", lower)
        if not words:
            return 0
        parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(part.encode(), 42) for part in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {row["doc_id"]: fingerprint(row["text"]) for row in table("documents")}
    group = {doc_id: doc_id for doc_id in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            least = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed |= least < group[a]
            group[a] = min(least, group[a])
    found = rows(spark, "op7_simhash")
    assert {row.doc_id: (row.fingerprint, row.component_id) for row in found} == {
        doc_id: (f"{bits:016x}", group[doc_id]) for doc_id, bits in prints.items()
    }


def test_op8_knows_held_out_documents(spark):
    known = {row["doc_id"]: row for row in table("documents", SF)}
    found = rows(spark, "op8_language", SF)
    assert sorted(row.doc_id for row in found) == sorted(known)
    right = total = 0
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
        if row.held_out:
            total += 1
            right += row.lang_pred == known[row.doc_id]["lang"]
    assert right >= 0.97 * total
