"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import random
import re
import textwrap
import time
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.llm import (
    chat, decontamination, extraction, fingerprints, language, licences, oracle, packing, queries, sharding, simhash, warc,
)
from forumlens.llm.blocks import MARK, leaf_blocks
from forumlens.llm.components import components
from forumlens.llm.labelled_pages import labelled_page
from forumlens.sources.snapshots import scratch_directory

# Names that operators use inside or return, as columns of the input.
CLASHING = (
    "shard slot rank rank_cell source fingerprint node component_id lang_pred score spans items words n_words piece length "
    "key own side signature formatted example page hex frame licence notices record"
).split()


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.select("*", *[F.lit("x").alias(name) for name in CLASHING])


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "en"), (5, "the same text again and again", "en"),
    (5, "the same text again and again", "en"), (6, "the same text again and again", "fr"), (None, "no id at all here", None),
    (7, "été œuvre 日本語 🎉 straße " * 3, "fr"), (8, "long " * 60_000, "en"), (9, "12 34 !!", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, ODD).limit(0)


def test_sharding(spark, odd, empty):
    def assigned(rows, weights=None, grown=None):
        weights = weights or sharding.equal_weights(4)
        return sharding.assign(rows, "doc_id", weights, grown or {**weights, 4: 1.0}, {"size": F.length("text")}).collect()

    found = assigned(odd)
    assert len(found) == len(ODD) and assigned(empty) == []
    assert all(row.grown_shard in (row.shard, 4) for row in found)
    for shard in {row.shard for row in found}:
        slots = sorted(row.slot for row in found if row.shard == shard)
        assert slots == list(range(len(slots)))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    heavy = {0: 1.0, 1: 1.0, 2: 2.0}
    counts = Counter(row.shard for row in assigned(many, heavy, {**heavy, 4: 4.0}))
    assert abs(counts[2] / 20_000 - 0.5) < 0.02 and abs(counts[0] / 20_000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), {0: 0.0})


def test_extraction_of_varied_pages(spark):
    field = extraction.train(extraction.labelled_pages(spark, 400))
    right = wrong = 0
    for number in range(50_000, 50_150):
        blocks = leaf_blocks(labelled_page(number))
        for block, kept in zip(blocks, field.decode(blocks)):
            right += block.marked == kept
            wrong += block.marked != kept
    assert right > 0.97 * (right + wrong)
    page = (
        "<header>My site<nav><a href=/>Home</a></nav></header><div class=cookie-notice><p>We use cookies.</p></div>"
        "<div class=sidebar><ul><li><a href=1>One thing</a></li></ul></div><article><h1>Title &amp; more</h1>"
        "<p>First  para\n of text<br>goes on.<p>Short.</p><script>var x='<p>no</p>'</script></article>"
        "<section id=comments><h3>Comments</h3><div class=comment><p>I liked it, thank you.</p></div></section>"
        "<form><label>Search</label><input></form><footer>&copy; 2024 Site</footer>"
    )
    rows = [(1, page, "a"), (2, None, "b"), (3, "", "c"), (4, "<div", "d"), (None, "<p>" + "x " * 50_000, "e")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("source", F.lit("z"))
    found = {r["source"]["page_id"]: r["text"] for r in extraction.extract(pages, field, ["page_id", "text"]).collect()}
    assert found[1] == "Title & more\nFirst para of text goes on.\nShort."
    assert found[2] == found[3] == found[4] == ""
    assert extraction.extract(pages.limit(0), field, ["page_id"]).count() == 0
    assert extraction.main_text("<p>kept", extraction.fit([])) == "kept"
    assert MARK not in "".join(field.features)


def foreign_page(draw, layout):
    """A page in a layout of its own, in English words that the training pages do not have, and its main blocks."""
    words = (
        "river market winter letter garden history people museum coffee railway science village music bridge weather harbour "
        "the of and a in to was with for on had from that were by the of and"
    ).split()

    def sentence(low=6, high=20):
        return " ".join(draw.choices(words, k=draw.randint(low, high))).capitalize()

    def links(count, around="{}"):
        return "".join(around.format(f'<a href="/{i}">{draw.choice(words).title()}</a> ') for i in range(count))

    def article(head):
        main = [sentence(3, 7), *[f"{sentence()}. {sentence()}." for _ in range(draw.randint(1, 5))]]
        return main, f"<{head}>{main[0]}</{head}>" + "".join(f"<p>{text}</p>" for text in main[1:])

    main, body = article("h1")
    if layout == "tables":
        cells = "".join(f"<tr><td>{part}</td></tr>" for part in re.findall(r"<h1>.*?</h1>|<p>.*?</p>", body))
        side = f"<td width=150>{links(6, '{}<br>')}</td>"
        rows = f"<tr><td colspan=2>{links(6)}</td></tr><tr>{side}<td><table>{cells}</table></td></tr><tr><td>Copyright 2003 Me</td></tr>"
        return f"<table>{rows}</table>", main
    if layout == "unnamed":
        menus = [f"<div><ul>{links(count, '<li>{}</li>')}</ul></div>" for count in (7, 5)]
        return f"{menus[0]}<div>{body}</div>{menus[1]}<div>&copy; 2020 Me. All rights reserved.</div>", main
    if layout == "commented":
        said = "".join(f"<li class=comment><b>Ann</b><p>{sentence()}.</p></li>" for _ in range(draw.randint(2, 6)))
        inside = f"{body}<div id=comments><h2>Comments</h2><ol>{said}</ol></div>"
        return f"<nav>{links(6)}</nav><article>{inside}</article><footer>About</footer>", main
    more, other = article("h2")
    posts = "".join(f"<article class=post>{text}</article>" for text in (body.replace("h1>", "h2>"), other))
    side = f"<aside><h3>Archive</h3><ul><li>{links(1)}</li></ul></aside>"
    return f"<header><h1>My blog</h1><nav>{links(6)}</nav></header><main>{posts}</main>{side}<footer>x</footer>", main + more


@pytest.mark.parametrize("layout", ["tables", "unnamed", "commented", "several"])
def test_extraction_of_other_layouts(spark, layout):
    field = extraction.train(extraction.labelled_pages(spark))
    right = 0
    for seed in range(100):
        page, main = foreign_page(random.Random(seed), layout)
        found = extraction.main_text(page, field)
        right += found == "\n".join(main)
        # The outermost elements change nothing, written or not.
        assert extraction.main_text(f"<!DOCTYPE html><html><head></head><body>{page}</body></html>", field) == found
    assert right >= 97


def test_blocks_keep_what_follows_empty_icons():
    page = (
        "<body><div><svg class=icon/><svg viewBox='0 0 1 1' /></div><article><p>The text with "
        "<math><mi>x</mi></math>.</p></article><footer><svg><path d='M0'/><text>no</text></svg>End</footer></body>"
    )
    assert [block.text for block in leaf_blocks(page)] == ["The text with x.", "End"]


def test_pages_that_stop_a_careless_reader(spark):
    field = extraction.train(extraction.labelled_pages(spark, 200))
    pages = [
        "<div>" * 10_000 + "<p>deep text</p>" + "</div>" * 10_000, "<blockquote>x" * 10_000, "<div>" * 3_000 + "</ul>x" * 50_000,
        "x <y " * 400_000, '<p title="a ' * 170_000, '<p title="a ' * 170_001 + ">", "<button>" * 250_000, "</button <button>" * 100_000,
        "<!" * 1_000_000, "<!--" * 500_000, "<a" * 1_000_000, "<svg>" * 250_000, "<" * 1_000_000,
    ]
    for page in pages:
        start = time.perf_counter()
        extraction.main_text(page, field)
        assert time.perf_counter() - start < 8, page[:20]
    assert "x <y x" in " ".join(block.text for block in leaf_blocks(pages[3]))


def test_field_equals_brute_force():
    draw = np.random.default_rng(4)
    html = ["<p>one</p><div>two words</div><h1>three</h1>", "<ul><li>a<li>b</ul>", "<p>x<p>y<p>z<p>w"]
    for page in html:
        blocks = leaf_blocks(page)
        names = {name for block in blocks for name in [*block.features, *(n for s in block.scope.chain() for n in s.features)]}
        field = extraction.Field({name: float(draw.normal()) for name in sorted(names)}, draw.normal(size=(2, 2, 2)))
        scores = [field.score(block) for block in blocks]
        same = [0] + [int(a.container == b.container) for a, b in zip(blocks, blocks[1:])]

        def weight(labels):
            total = sum(score for score, label in zip(scores, labels) if label)
            return total + sum(field.pairs[same[i], labels[i - 1], labels[i]] for i in range(1, len(labels)))

        every = list(product((0, 1), repeat=len(blocks)))
        weights = np.exp([weight(labels) for labels in every])
        assert tuple(field.decode(blocks)) == every[int(np.argmax(weights))]
        chance = weights / weights.sum()
        on, pairs = extraction._marginals(np.array([scores]), field.pairs, np.array([same]), np.ones((1, len(blocks)), bool))
        expected = [sum(c for c, labels in zip(chance, every) if labels[i]) for i in range(len(blocks))]
        assert np.allclose(on[0], expected)
        counts = np.zeros((2, 2, 2))
        for c, labels in zip(chance, every):
            for i in range(1, len(blocks)):
                counts[same[i], labels[i - 1], labels[i]] += c
        assert np.allclose(pairs, counts)


def test_blocks_use_all_names():
    page = "<div class='mt-4 px-2 py-3 w-full max-w-lg text-sm flex-row sidebar'><p>Some text.</p></div>"
    assert any("name:sidebar" in scope.features for scope in leaf_blocks(page)[0].scope.chain())


def test_packing(spark, odd, empty):
    path = queries.tokenizer_path()
    found = packing.pack(odd, path).collect()
    assert packing.pack(empty, path).count() == 0
    assert Counter(row.doc_id for row in found if row.start == 0) == Counter(row[0] for row in ODD)
    assert {(row.doc_id, row.length) for row in found if row.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    quick = packing.pack(odd, path, ranks=queries.tokenizer_path(queries.RANKS)).select("doc_id", "piece", "start", "ids_crc32")
    assert sorted(map(tuple, quick.collect()), key=repr) == sorted(((r.doc_id, r.piece, r.start, r.ids_crc32) for r in found), key=repr)


TEXTS = (
    "a   b  c \n d\n\n e\t f ", "'s 't don't", "x\x1cy \x85z\xa0", "日本 語", "é½² 3.14 <|endoftext|>", " ", "\n\n a", "x <|endoftext|> y",
    "<|endoftext|>", " lead", "trail ", "x\n \ny", "two  blanks  here", "plain words of one text", "Ünï cödé ɐ ɏ words", "a" * 3000 + " b",
)


@pytest.mark.parametrize("ranks", [None, queries.tokenizer_path(queries.RANKS)])
def test_ids_are_those_of_the_tokenizer(ranks, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    expected = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    tokens = packing._Tokens(queries.tokenizer_path(), ranks)
    for _ in range(2):
        assert tokens.of([text.encode() for text in TEXTS]) == expected
    assert all(len(word) <= packing._LONGEST for word in tokens.words)
    monkeypatch.setattr(packing, "_KEPT", 0)
    assert tokens.of([text.encode() for text in TEXTS]) == expected


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_demand(seed):
    draw = random.Random(seed)
    demand = {length: draw.randint(0, 10 ** (1 + seed)) for length in draw.sample(range(1, 101), 40)} | {100: 3}
    planned = packing.plan(demand, 100)
    held = Counter()
    for lengths, times in planned:
        assert sum(lengths) <= 100 and times > 0
        for length in lengths:
            held[length] += times
    assert held == Counter({length: count for length, count in demand.items() if count})
    simple = defaultdict(dict)
    packing._best_fit(dict(demand), 100, simple)
    assert sum(times for _, times in planned) <= 1.01 * sum(sum(found.values()) for found in simple.values()) + 1
    assert packing.plan({}, 100) == []


def fewest_bins(lengths, capacity):
    """The least number of bins, by search."""
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for room in sorted({room for room in bins if room >= rest[0]}):
            left = list(bins)
            left[left.index(room)] -= rest[0]
            place(rest[1:], left)
        place(rest[1:], [*bins, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_near_the_optimum_of_small_instances(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 11))]
    used = sum(times for _, times in packing.plan(dict(Counter(lengths)), 20))
    assert fewest_bins(lengths, 20) <= used <= fewest_bins(lengths, 20) + 1


def test_warc(spark):
    rows = [
        (1, "http://a b\n", "<p>x"), (2, None, "<p>x"), (None, "u", "<p>x"), (3, "u", None), (4, "u", ""),
        (5, "é", "é\r\n\r\nWARC/1.1 " + "y" * 300_000), (5, "é", "other"), (6, "v", "same"), (6, "v", "same"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("frame", F.lit("z"))
    directory = scratch_directory(spark)
    warc.write_archives(pages, directory)
    found = warc.read_archives(spark, directory).collect()
    kinds = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in found)
    assert kinds == sorted([
        (1, 4, "revisit", 2), (2, 4, "response", None), (0, 4, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None),
        (5, 300_015, "response", None), (5, 5, "response", None), (6, 4, "response", None), (6, 4, "response", None),
    ])
    assert {r.payload for r in found if r.record_type == "response"} == {"<p>x", "", rows[5][2], "other", "same"}
    directory = scratch_directory(spark)
    warc.write_archives(pages.limit(0), directory)
    assert warc.read_archives(spark, directory).count() == 0


def test_warc_dictionary_knows_headers(spark):
    texts = [(i, f"http://host{i % 7}.example/page/{i}", f"<html><p>page {i} says {i * i}</p></html>") for i in range(300)]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string")
    date = "2024-01-01T00:00:00Z"
    trained = warc.train_dictionary(pages, "page_id", "url", "html", date)
    assert b"WARC-" in trained and b"msgtype=response" in trained
    assert warc.train_dictionary(pages.limit(0), "page_id", "url", "html", date) == b""
    few = warc.train_dictionary(pages.limit(1), "page_id", "url", "html", date)
    assert few.startswith(b"WARC/1.1\r\n") and len(few) <= warc.SAMPLE_BYTES
    record = warc._record("response", 5, texts[5][1], date, "A" * 32, 20, b"<html><p>other</p>", "")
    assert len(warc._compressor(trained).compress(record)) < 0.5 * len(warc._compressor(b"").compress(record))


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "Again, and AGAIN"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, "!!"), (1, "again and again")],
        "item_id long, text string",
    )
    more = odd.select("doc_id", "text").unionByName(
        spark.createDataFrame([(20, "Zero. One two three four five six seven eight nine ten; eleven! Twelve")], "doc_id long, text string")
    )
    found = decontamination.scan(more, items, ["doc_id"]).select("source.doc_id", "*").collect()
    hits = {row.doc_id: (row.n_words, row.n_hit, sorted(row["items"])) for row in found}
    assert hits[20] == (13, 11, ["2"]) and hits[5] == (6, 3, ["1"]) and hits[1] == hits[2] == (0, 0, [])
    assert len(found) == len(ODD) + 1
    sliced = decontamination.scan(more, items, ["doc_id"], slice_windows=1).select("source.doc_id", "*").collect()
    assert {row.doc_id: (row.n_words, row.n_hit, sorted(row["items"])) for row in sliced} == hits
    kept = decontamination.clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.where("doc_id in (5, 6)").count() == 0 and kept.count() == len(ODD) - 3
    cut = {row.doc_id: row.text for row in decontamination.without_spans(more, items).collect()}
    assert cut[20] == "Zero. ! Twelve" and cut[1] is None and cut[5] == "the same text "
    assert decontamination.scan(empty, items, ["doc_id"]).count() == 0
    assert decontamination.clean_documents(odd, items.limit(0)).count() == len(ODD)


def test_fingerprints(spark, odd, empty):
    found = fingerprints.edited_fingerprints(odd).collect()
    assert len(found) == len(ODD) and fingerprints.edited_fingerprints(empty).count() == 0
    prints = {}
    for row in found:
        prints.setdefault(row.doc_id, set()).add(row.fingerprint)
    assert prints[5] == prints[6] and len(prints[5]) == 1
    assert prints[1] == prints[2] == prints[3] == {"0" * fingerprints.SAMPLES * fingerprints.DIGITS}
    single = fingerprints.edited_fingerprints(odd.where("doc_id = 7")).collect()
    assert [(row.near_next, row.doc_id) for row in single] == [(1.0, 7)]


def test_simhash(spark, odd, empty):
    found = simhash.near_duplicates(odd).collect()
    groups = Counter((row.doc_id, row.component_id) for row in found)
    assert groups[(5, 5)] == 2 and groups[(6, 5)] == 1
    assert groups[(1, 1)] == groups[(2, 1)] == groups[(3, 1)] == 1 and len(found) == len(ODD)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("count", [10, 10**6, 10**10])
def test_tables_lose_no_link(count):
    draw = random.Random(count)
    tables = simhash.lossless_tables(64, 4, count)
    for _ in range(200):
        flipped = set(draw.sample(range(64), 4))
        assert any(not flipped.intersection(chosen) for chosen in tables)


def test_large_buckets_are_cut_without_loss(spark):
    draw = random.Random(1)
    centres = [draw.getrandbits(64) for _ in range(3)]
    prints = list({c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for c in centres for _ in range(150)})
    rows = [(i, value.to_bytes(8, "big")) for i, value in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, fingerprint binary")
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            best = min(least[b] for b in range(len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed |= best < least[a]
            least[a] = min(least[a], best)
    for chunk in (16, 4096):
        links = simhash.links(nodes, 4, simhash.lossless_tables(64, 4, len(prints)), chunk)
        labels = {row.node: row.label for row in components(links).collect()}
        groups = {}
        for node in range(len(prints)):
            groups.setdefault(labels.get(node, ("alone", node)), set()).add(node)
        expected = {}
        for node, low in enumerate(least):
            expected.setdefault(low, set()).add(node)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (60, 61), (None, 3)] + [(100, i) for i in range(101, 160)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(1, 41)}) == 1 and len({labels[i] for i in (50, 60, 61)}) == 1
    assert len(set(labels.values())) == 3 and 70 not in labels
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark, odd, empty):
    texts = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]
    profiles = language.train(documents(spark, texts))
    found = {row.source.doc_id: (row.lang_pred, row.score) for row in language.predict(odd, profiles, ["doc_id"]).collect()}
    assert found[1] == found[2] == found[3] == found[9] == (language.UNKNOWN, 0.0)
    assert found[5][0] == "en" and len(found) == len({row[0] for row in ODD})
    assert language.predict(empty, profiles, ["doc_id"]).count() == 0
    nothing = language.train(empty)
    assert {row.lang_pred for row in language.predict(odd, nothing, ["doc_id"]).collect()} == {language.UNKNOWN}
    encoder = language._Encoder()
    long = "word salad " * 60_000
    whole, parts = encoder.vectors([long, long[:1100]])
    cosine = whole @ parts / (whole @ whole * (parts @ parts)) ** 0.5
    assert cosine > 0.999


def test_language_equals_a_naive_version(spark):
    """Letters bound in order, bundled and compared one by one."""
    encoder = language._Encoder()

    def bundled(text):
        letters = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        total = np.zeros(encoder.dimensions)
        for at in range(len(letters) - 2):
            bound = np.zeros(encoder.dimensions, np.uint8)
            for place in range(3):
                bits = encoder.letter_bits(np.array([ord(letters[at + place])]))[0]
                bound = (bound + np.roll(bits, 2 - place)) % 2
            total += 1 - 2.0 * bound
        return total

    texts = ["the cat", "A dog, and 2 cats!", "le chien où", "ça va ça va", "x"]
    assert np.array_equal(encoder.vectors(texts), [bundled(text) for text in texts])
    labelled = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]
    profiles = language.train(documents(spark, labelled))
    rows = documents(spark, [(i, text, None) for i, text in enumerate(texts)])
    found = {row.source.doc_id: row.lang_pred for row in language.predict(rows, profiles, ["doc_id"]).collect()}
    for number, text in enumerate(texts[:4]):
        cosines = [bundled(text) @ vector / np.linalg.norm(bundled(text)) for vector in profiles.vectors]
        assert found[number] == profiles.languages[int(np.argmax(cosines))]


def test_chat(spark):
    rows = [
        (1, 0, "system", "Be <b> & [INST]"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s> <|end|>\n &lt; &amp;"),
        (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "alone"), (3, None, None, "?"), (3, 1, "assistant", "a"),
        (3, 1, "assistant", "a"), (None, 0, "assistant", "x|>\ny"), (4, 0, "assistant", "z" * 100_000), (5, 0, "od<|d\nrole", "t\n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.select("*", F.lit("x").alias("formatted"), F.lit("y").alias("example"))
    examples = chat.expand(turns)
    trained = chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    found = examples.select("*", trained.alias("t"), chat.turns_of(F.col("formatted")).alias("said")).collect()
    replies = Counter((row.conv_id, row.t) for row in found if row.loss_start is not None)
    assert replies == Counter((c, t or "") for c, _, r, t in rows if r == "assistant")
    for conversation in {row[0] for row in rows}:
        last = max((row for row in found if row.conv_id == conversation), key=lambda row: row.example)
        expected = sorted(
            ((-1 if n is None else n, r or "", t or "") for c, n, r, t in rows if c == conversation)
        )
        assert [(s.role, s.text) for s in last.said] == [(r, t) for _, r, t in expected]
    assert all("[INST]" not in row.formatted and "</s>" not in row.formatted for row in found)
    assert chat.expand(turns.limit(0)).count() == 0


def test_licences(spark, odd, empty):
    known = licences.known_licences(spark)
    texts = dict(licences.KNOWN_TEXTS)
    varied = "Copyright (c) 2020 Someone\n\n" + texts["MIT"].upper().replace(",", " ;").replace("SUBLICENSE", "sublicence")
    rows = [
        (1, "MIT Licence\n\n(C) 2021 me\n" + licences._MIT), (2, "More.\nlicensed under  CC BY-NC 4.0\nReleased under the MIT licence."),
        (3, None), (4, ""), (4, "x"), (None, texts["ISC"]), (5, "A " + texts["ISC"]), (6, varied),
    ]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    matched = sorted(((row.doc_id or 0, row.licence, row.notices) for row in found), key=repr)
    assert (1, "MIT", "") in matched and (0, "ISC", "") in matched and (5, None, "") in matched
    assert (2, None, "CC-BY-NC-4.0,MIT") in matched and len(found) == len(rows)
    assert licences.scan(odd, known).count() == len(ODD) and licences.scan(empty, known).count() == 0


def test_licences_in_any_layout(spark):
    rows, expected = [], []
    for licence, text in licences.KNOWN_TEXTS:
        paragraphs = [" ".join(part.split()) for part in re.split(r"\n\s*\n", text)]
        for width in (*range(30, 121), 100000):
            wrapped = "\n\n".join(textwrap.fill(part, width, break_long_words=False) for part in paragraphs)
            rows += [wrapped, "Copyright (c) 2020 Someone\n\n" + wrapped, "Copyright Some One\n\n" + wrapped]
        rows.append(" ".join(paragraphs))
        expected += [licence] * (len(rows) - len(expected))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {row.doc_id: row.licence for row in licences.scan(frame, licences.known_licences(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == expected


HEADS = (
    "Copyright (c) 2020 Foo\nAll rights reserved.\n\n", "The MIT License\n\n", "Copyright Foo Inc.\n", "Copyright  Foo Inc.\n\n",
    "The MIT License (MIT)\r\n\r\nCopyright (c) 2020 Foo\r\n\r\n", "MIT License\n\nCopyright Foo Inc.\n", "(C) 1999 A. B.\n",
    "\n\n * Copyright 2001-2004 Foo\n * ALL RIGHTS RESERVED\n *\n",
)


def test_licences_below_usual_heads(spark):
    def first(name):
        return next(text for licence, text in licences.KNOWN_TEXTS if licence == name)

    rows = [(f"{number}", head + first("MIT"), "MIT") for number, head in enumerate(HEADS)]
    rows += [("b", HEADS[0] + first("BSD-2-Clause"), "BSD-2-Clause"), ("c", HEADS[0] + first("Unlicense"), "Unlicense")]
    rows += [("d", "Copyright  holders agree\n" + first("MIT"), None), ("e", "Copyright Foo Inc.", None), ("f", "All rights reserved", None)]
    rows += [("g", first("MIT") + "\nCopyright Foo Inc.\nmore", None), ("h", "The MIT License" * 9 + first("MIT"), None)]
    frame = spark.createDataFrame([row[:2] for row in rows], "doc_id string, text string")
    found = {row.doc_id: row.licence for row in licences.scan(frame, licences.known_licences(spark)).collect()}
    assert found == {key: licence for key, _, licence in rows}


def test_licences_equal_their_sql(spark):
    draw = random.Random(6)
    lines = [
        "", "", "", " ", "Copyright Foo", "Copyright (c) 2020 Foo", "copyright notice of it", "All rights reserved.", "(c) 2020", "(c) Foo",
        "© Foo", "Copyright", "copyright " + "x" * 80, "copyright " + "x" * 79, "-- Copyright  Bar --", "copyright  holders are", "Licence, whilst",
        "all rights reserved by Foo", "Released under the MIT Licence.", "plain text\r", "Copyright Foo\r", "\r", "copyright 'owner'", "© é",
    ]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randint(0, 7)))) for i in range(3_000)]
    rows += [(10_000 + i, head + text) for i, head in enumerate(HEADS) for _, text in licences.KNOWN_TEXTS[:3]]
    rows = [(i, text) for i, (_, text) in enumerate(rows)] + [(99_999, None)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_licences(spark))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    answer = connection.execute(oracle.all_oracles()["op10_licences"]).fetchall()
    assert sorted(map(tuple, found.select("doc_id", "text_digest", "licence", "notices").collect())) == sorted(answer)


def test_licences_of_a_table(spark):
    listed = [("A", "Do what you like, whilst you can."), ("B", "do what you like while you can"), ("C", " !"), (None, "x"), ("D", None)]
    known = licences.known_texts(spark.createDataFrame(listed, "licence string, text string"))
    assert [row.licence for row in known.collect()] == ["A"]
    rows = spark.createDataFrame([(1, "DO WHAT YOU LIKE\nwhile you can"), (2, "!"), (3, "x")], "doc_id long, text string")
    assert {row.doc_id: row.licence for row in licences.scan(rows, known).collect()} == {1: "A", 2: None, 3: None}


NATIVE = ("op6_fingerprints", "op9_prefix_targets", "op10_licences")


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    frame = queries.all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_language_and_decontamination_send_only_texts_to_python(spark, odd):
    """Rows that carry all their columns stay in the JVM: a task once held every text four times, outside its heap too."""
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    profiles = language.train(documents(spark, [(1, "some english words", "en")]))
    found = language.predict(odd, profiles, odd.columns)
    for frame in (found, decontamination.scan(odd, items, odd.columns), decontamination.clean_documents(odd, items)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    # A filter on what is found does not repeat the call.
    plan = found.where((F.col("score") > 0) & (F.col("lang_pred") == "en"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(map(repr, found.select("source.*").collect())) == sorted(map(repr, odd.collect()))
