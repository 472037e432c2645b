"""Ranked search by clauses on a keyword index.

A clause is a word that must, should or must not occur, a phrase, or the start of a word. Clauses become units: a word, a
phrase or a word start, each of which a post has or lacks. Spans of posts are looked at before posts: a span without a
required word is left out, and the blocks of its words bound the scores in it. The best spans of a query are scored first;
the score of its last result there decides which other spans can still matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlens.functions import scoring, text
from forumlens.operators import keyword_index, phrases
from forumlens.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, SALTS
from forumlens.operators.keyword_index import MESSAGE, TITLE, KeywordIndex
from forumlens.operators.ranking import top_per_query, with_result_limit, within_own_limit, worth_ranking
from forumlens.schemas import TITLE_BOOST
from forumlens.sources.snapshots import materialize

MUST, SHOULD, MUST_NOT, PHRASE, PREFIX = "must", "should", "must_not", "phrase", "prefix"
REQUIRED = (MUST, PHRASE, PREFIX)
# Spans of a query that are scored first, and the decimals at which scores compare.
FIRST_SPANS, DECIMALS = 4, 9
_BOOSTS = {TITLE: TITLE_BOOST, MESSAGE: 1.0}
# Units that meet the postings of a span in one group, and cells and pairs of query and post that a task holds at once.
GROUP_UNITS, _CELLS, _PAIRS = 1 << 17, 1 << 20, 1 << 21
_MATCHES = "query_id long, post_id long, date long, relevance double"
# Spans whose blocks meet the units in one group, and blocks of a group that many asked words may have in one field; recency
# in a bound is a whole number of steps, rounded up.
REGION_SPANS, REGION_BLOCKS, _RECENT_STEPS = 64, 1 << 20, 1 << 30
_SPANS = "query_id long, span long, bound double"


def must_clauses(queries: DataFrame) -> DataFrame:
    """Every different word of every query as a required clause."""
    found = queries.select("query_id", F.array_distinct(text.words(F.col("query"))).alias("words"))
    return found.select("query_id", F.posexplode("words").alias("clause_no", "text")).withColumn("kind", F.lit(MUST))


def _boost() -> Column:
    return F.when(F.col("field") == TITLE, _BOOSTS[TITLE]).otherwise(_BOOSTS[MESSAGE])


class Units:
    """The units of a batch of clauses, written once.

    ``words``: ``query_id, bit, kind, term`` of single words; ``phrases``: ``query_id, bit, kind, phrase``; ``prefixes``:
    ``query_id, bit, kind, start``; ``bit`` numbers the required units of a query from 0 and is -1 for the others.
    ``needed``: required units of every query with a clause. ``groups``: parts of the batch that meet the postings of a span
    one by one. ``region``: spans whose blocks the batch meets at once.
    """

    def __init__(self, clauses: DataFrame):
        found = clauses.select("query_id", "clause_no", "kind", text.words(F.col("text")).alias("words"))
        required = F.col("kind").isin(*REQUIRED)
        # A required clause without a word cannot be met, but it is needed.
        single = F.col("kind").isin(MUST, SHOULD, MUST_NOT) & (F.size("words") > 0)
        texts = F.when(single, F.col("words")).otherwise(F.array(F.array_join("words", " ")))
        each = found.select("query_id", "clause_no", "kind", required.alias("required"), F.posexplode(texts).alias("part", "text"))
        order = Window.partitionBy("query_id", "required").orderBy("clause_no", "part", "kind", "text")
        bit = F.when(F.col("required"), F.row_number().over(order) - 1).otherwise(-1)
        self.rows = materialize(each.select("query_id", "kind", "required", "text", bit.alias("bit")))
        self.needed = self.rows.groupBy("query_id").agg(F.count_if("required").alias("needed"))
        sized = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
        figures = self.rows.agg(F.count("*"), sized).first()
        self.groups = max(1, -(-figures[0] // GROUP_UNITS))
        self.region = max(1, min(REGION_SPANS, REGION_BLOCKS // max(1, figures[0])))
        self.few = figures[0] <= BROADCAST_ROWS and figures[1] <= BROADCAST_BYTES
        known = self.rows.where(F.col("text") != "").select("query_id", "bit", "kind", "text")
        self.words = known.where(F.col("kind").isin(MUST, SHOULD, MUST_NOT)).withColumnRenamed("text", "term")
        self.phrases = known.where(F.col("kind") == PHRASE).withColumnRenamed("text", "phrase")
        self.prefixes = known.where(F.col("kind") == PREFIX).withColumnRenamed("text", "start")
        self.phrase_words = self.phrases.select("phrase").distinct().select(
            "phrase", F.size(F.split("phrase", " ")).alias("size"), F.posexplode(F.split("phrase", " ")).alias("offset", "term")
        )
        self.kinds = {row["kind"] for row in self.rows.select("kind").distinct().collect()}
        self.single = bool(self.kinds & {MUST, SHOULD, MUST_NOT}) or not self.kinds & {PHRASE, PREFIX}

    def asked(self) -> DataFrame | None:
        """The words that postings are needed of; None where word starts ask for words that are not known yet."""
        if PREFIX in self.kinds:
            return None
        asked = self.words.select("term").union(self.phrase_words.select("term")).distinct()
        return F.broadcast(asked) if self.few else asked


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sized(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


class Search:
    """One batch of clauses against one index."""

    def __init__(self, index: KeywordIndex, units: Units):
        self.index, self.units = index, units
        corpus = index.corpus.select(
            F.struct(
                "posts",
                (F.col("title_words") / F.nullif("posts", F.lit(0))).alias("average_title"),
                (F.col("message_words") / F.nullif("posts", F.lit(0))).alias("average_message"),
            )
        ).scalar()
        self.average = F.when(F.col("field") == TITLE, corpus["average_title"]).otherwise(corpus["average_message"])
        # Of the dictionary, only asked words take part; word starts become the words that begin so.
        asked = units.words.select("term").union(units.phrase_words.select("term")).distinct()
        known = index.terms.join(_sized(asked, units.few), "term")
        self.weights = materialize(
            known.select(
                "term",
                (F.col("title_posts") + F.col("message_posts")).alias("held"),
                scoring.inverse_document_frequency(corpus["posts"], F.col("title_posts")).alias("title_idf"),
                scoring.inverse_document_frequency(corpus["posts"], F.col("message_posts")).alias("message_idf"),
            )
        )
        self.words = units.words.join(self.weights, "term")
        single = _sized(units.words.select("term").distinct(), units.few)
        self.single = self.weights.where(F.col("held") > 0).join(single, "term", "left_semi")
        self.phrase_hits = self._phrase_hits() if PHRASE in units.kinds else None
        self.starts = materialize(self._started()) if PREFIX in units.kinds else None

    def _idf(self) -> Column:
        return F.when(F.col("field") == TITLE, F.col("title_idf")).otherwise(F.col("message_idf"))

    def _phrases(self) -> tuple[DataFrame, DataFrame]:
        """Words of the phrases whose words are all known, and these phrases with their words in order and summed weights."""
        held = self.units.phrase_words.join(self.weights, "term")
        whole = held.groupBy("phrase", "size").agg(
            F.count("*").alias("found"),
            F.sum("title_idf").alias("title_idf"),
            F.sum("message_idf").alias("message_idf"),
        )
        whole = whole.where(F.col("found") == F.col("size")).drop("found")
        words = held.join(whole.select("phrase"), "phrase", "left_semi").select("term").distinct()
        return words, whole.withColumn("words", F.split("phrase", " "))

    def _phrase_hits(self) -> DataFrame:
        """``phrase, span, field, post_id, date, weight``: fields of posts where a phrase stands, written.

        Postings of the phrases' words meet by post and field, and tasks read the phrases from the shared folder: no pair of
        phrase and posting moves, only what was found.
        """
        words, whole = self._phrases()
        asked = _sized(self.index.keyed(words), self.units.few)
        held = self.index.live(self.index.postings.join(asked, self.index.key, "left_semi"))
        found = phrases.standing(held.where(F.col("post_id").isNotNull()), whole.select("phrase", "words"))
        scored = found.join(_sized(whole.drop("words"), self.units.few), "phrase")
        weight = _boost() * scoring.bm25(F.col("times"), F.col("length"), self.average, self._idf())
        return materialize(scored.select("phrase", "span", "field", "post_id", "date", weight.alias("weight")))

    def _started(self) -> DataFrame:
        """``start, term``: words of the dictionary that begin with an asked start.

        Only words of the dictionary are cut, at the lengths that are asked for. The asked starts are broadcast if they
        are few; else words of one start are spread by salt.
        """
        starts = self.units.prefixes.select("start").distinct()
        self.lengths = [row[0] for row in starts.select(F.length("start").alias("n")).distinct().orderBy("n").collect()]
        cut = self._cut(self.index.terms, "term")
        if self.units.few:
            return cut.join(F.broadcast(starts), "start")
        salted = cut.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
        copies = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, ["start", "salt"]).drop("salt")

    def _cut(self, rows: DataFrame, *carry: str) -> DataFrame:
        """``carry, start``: rows with ``term``, once for every asked length that it has, cut there."""
        cuts = F.array(*[F.when(F.length("term") >= n, F.left("term", F.lit(n))) for n in self.lengths])
        return rows.select(*carry, F.explode(F.array_compact(cuts)).alias("start"))

    def _blocks_of(self, words: DataFrame) -> DataFrame:
        """Blocks of ``words`` (``term`` and more); a word's blocks of all segments."""
        return self.index.blocks.join(self.index.keyed(words), self.index.key)

    def _asked(self, units: DataFrame) -> DataFrame:
        """Units with the part of the batch that their query is in, and how many units it needs."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(self.units.groups)).alias("part")
        return units.join(_sized(self.units.needed, self.units.few), "query_id").select("*", part)

    def _in_parts(self, rows: DataFrame) -> DataFrame:
        """Every row once for each part of the batch."""
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.units.groups - 1)).cast("array<bigint>")))

    def spans(self, origin: Column | None = None) -> DataFrame:
        """``query_id, span, bound``: spans that may hold a match of a query, and what no score there exceeds.

        A unit's bound in a span: for a word, its weight at the most occurrences in the shortest field; for a phrase, the
        most that a post has of it; for a word start, what it adds in both fields. Blocks and units meet by region, so the
        pairs of query and block exist inside tasks alone.
        """
        nearest = F.least(F.greatest(origin, F.col("first_date")), F.col("last_date")) if origin is not None else None
        recent = F.when(F.col("undated"), F.lit(1.0)).otherwise(scoring.recency(nearest, origin)) if origin is not None else F.lit(0.0)
        word = _boost() * scoring.bm25(F.col("most"), F.col("least"), self.average, self._idf())
        held, asked = [], []

        def unit(letter: str, name: str) -> Column:
            return F.concat(F.lit(letter + " "), name).alias("unit")

        if self.units.single:
            blocks = self._blocks_of(_sized(self.single, self.units.few))
            held.append(blocks.select(unit("w", "term"), "span", "field", word.alias("bound"), recent.alias("recent")))
            asked.append(self.words.where(F.col("kind") != MUST_NOT).select("query_id", unit("w", "term"), "kind", "bit"))
        if self.phrase_hits is not None:
            recent_post = scoring.recency(F.col("date"), origin) if origin is not None else F.lit(0.0)
            by_post = self.phrase_hits.groupBy("phrase", "span", "post_id").agg(F.sum("weight").alias("bound"), F.max(recent_post).alias("recent"))
            places = by_post.groupBy("phrase", "span").agg(F.max("bound").alias("bound"), F.max("recent").alias("recent"))
            held.append(places.select(unit("p", "phrase"), "span", F.lit(MESSAGE).alias("field"), "bound", "recent"))
            asked.append(self.units.phrases.select("query_id", unit("p", "phrase"), "kind", "bit"))
        if self.starts is not None:
            places = self._blocks_of(self.starts).groupBy("start", "span").agg(F.max(recent).alias("recent"))
            both = F.lit(sum(_BOOSTS.values())).alias("bound")
            held.append(places.select(unit("s", "start"), "span", F.lit(MESSAGE).alias("field"), both, "recent"))
            asked.append(self.units.prefixes.select("query_id", unit("s", "start"), "kind", "bit"))
        steps = F.ceil(F.col("recent") * _RECENT_STEPS).alias("recent")
        region = F.floor(F.col("span") / self.units.region).alias("region")
        blocks = _union(held).where(F.col("span").isNotNull()).select("unit", "span", "field", "bound", steps, region)
        # A unit goes to the regions that have it.
        there = materialize(blocks.select("unit", "region").distinct())
        units = there.join(_sized(self._asked(_union(asked)), self.units.few), "unit")
        met = self._in_parts(blocks).groupBy("region", "part").cogroup(units.groupBy("region", "part"))
        return met.applyInArrow(spans_of_group, _SPANS)

    def _postings_of(self, wanted: DataFrame) -> DataFrame:
        """Live postings of ``wanted`` (``term, span`` and more). A word has no more postings in a span than the span has
        posts and fields, so no key is hot."""
        keyed = self.index.keyed(wanted)
        return self.index.live(self.index.postings.join(keyed, [*self.index.key, "span"]))

    def scores(self, spans: DataFrame) -> DataFrame:
        """``query_id, post_id, date, relevance`` of all matches in ``spans`` (``query_id, span``), a written table."""
        held, asked = [], []
        if self.units.single:
            words = self.words.select("query_id", "bit", "kind", "term").join(spans, "query_id")
            weight = _boost() * scoring.bm25(F.size("positions"), F.col("length"), self.average, self._idf())
            postings = self._postings_in(spans) if self.units.few else self._postings_of(words.select("term", "span").distinct().join(self.weights, "term"))
            held.append(postings.select("span", F.concat(F.lit("w "), "term").alias("unit"), "post_id", "date", weight.alias("weight")))
            asked.append(words.withColumn("unit", F.concat(F.lit("w "), "term")).drop("term"))
        if PHRASE in self.units.kinds:
            asked.append(self.units.phrases.join(spans, "query_id").select("query_id", "bit", "kind", F.concat(F.lit("p "), "phrase").alias("unit"), "span"))
            held.append(self.phrase_hits.select("span", F.concat(F.lit("p "), "phrase").alias("unit"), "post_id", "date", "weight"))
        if self.starts is not None:
            places, found = self._prefix_hits(spans)
            asked.append(places.withColumn("unit", F.concat(F.lit("s "), "start")).drop("start"))
            held.append(found.withColumn("unit", F.concat(F.lit("s "), "start")).drop("start"))
        # Postings and units of a span meet in one group, so the pairs of query and posting exist inside tasks alone.
        units = self._asked(_union(asked)).select("span", "part", "query_id", "unit", "kind", "bit", "needed")
        postings = self._in_parts(_union(held).where(F.col("span").isNotNull()))
        met = postings.groupBy("span", "part").cogroup(units.groupBy("span", "part"))
        return met.applyInArrow(matches_of_group, _MATCHES)

    def _postings_in(self, spans: DataFrame) -> DataFrame:
        """Live postings of single words in any of the ``spans``, found where they lie: few words, and the list of spans, go
        to the postings."""
        held = self.index.postings.join(F.broadcast(self.index.keyed(self.single)), self.index.key)
        return self.index.live(held.join(F.broadcast(spans.select("span").distinct()), "span", "left_semi"))

    def _prefix_hits(self, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Word starts of the queries with their spans, and posts with a word that begins as asked; a field counts once, however many such words it has.

        Words are cut where their postings lie, so a start never meets the words of the dictionary once for each span. Few
        starts, and the list of spans, go to the postings; only what begins as asked moves.
        """
        places = self.units.prefixes.join(spans, "query_id").select("query_id", "bit", "kind", "start", "span")
        asked = materialize(places.select("start", "span").distinct())
        held, carried = self.index.postings, ("span", "post_id", "field", "date", "segment")
        if self.units.few:
            held = held.join(F.broadcast(asked.select("span").distinct()), "span", "left_semi")
            if asked.count() <= BROADCAST_ROWS:
                cut = self._cut(held, *carried).join(F.broadcast(asked), ["start", "span"], "left_semi")
            else:  # where a span has other starts as well, their posts meet no unit
                cut = self._cut(held, *carried).join(F.broadcast(asked.select("start").distinct()), "start", "left_semi")
        else:
            cut = self._cut(held, *carried).join(asked, ["start", "span"], "left_semi")
        boosts = [F.max(F.when(F.col("field") == field, boost).otherwise(0.0)) for field, boost in _BOOSTS.items()]
        found = self.index.live(cut).groupBy("start", "span", "post_id").agg(F.max("date").alias("date"), sum(boosts[1:], boosts[0]).alias("weight"))
        return places, found


def spans_of_group(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Spans with their bounds, of the blocks of one region (``unit, span, field, bound, recent``) and ``asked`` as in
    :func:`matches_of_group`. Segments do not share posts, so the largest bound of a field counts; fields add up."""
    blocks = held.group_by(["unit", "span", "field"]).aggregate([("bound", "max"), ("recent", "max")])
    blocks = blocks.select(["unit", "span", "recent_max", "bound_max"]).rename_columns(["unit", "post_id", "date", "weight"])
    found = matches_of_group(blocks, asked)
    recent = found.column("date").to_numpy() / _RECENT_STEPS
    bound = pa.array(found.column("relevance").to_numpy() + recent, pa.float64())
    return pa.table([found.column("query_id"), found.column("post_id"), bound], ["query_id", "span", "bound"])


def matches_of_group(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Matches among the posts of one span, of ``held`` (``unit, post_id, date, weight``) and ``asked`` (``query_id, unit, kind,
    bit, needed``). A unit counts once for a post, however many postings say it; a post has the latest date of its postings."""
    names = ["query_id", "post_id", "date", "relevance"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    found: list[list[np.ndarray]] = [[], [], [], []]
    if held.num_rows and asked.num_rows:
        texts = pa.concat_arrays([part.cast(pa.string()) for table in (held, asked) for part in table.column("unit").chunks])
        codes = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
        posts, place = np.unique(held.column("post_id").to_numpy(), return_inverse=True)
        # One row for each unit and post, sorted by unit.
        keys, row = np.unique(codes[: held.num_rows] * len(posts) + place, return_inverse=True)
        weight = np.bincount(row, held.column("weight").to_numpy(), len(keys))
        unknown = np.iinfo(np.int64).min
        date = np.full(len(keys), unknown)
        np.maximum.at(date, row, held.column("date").fill_null(unknown).to_numpy())
        unit, place = np.divmod(keys, len(posts))

        queries, number = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
        order = np.argsort(number, kind="stable")
        number, code = number[order], codes[held.num_rows :][order]
        kind, bit = np.array(asked.column("kind").to_pylist())[order], asked.column("bit").to_numpy()[order]
        needed = np.zeros(len(queries), np.int64)
        needed[number] = asked.column("needed").to_numpy()[order]
        first = np.searchsorted(unit, code)
        sizes = np.searchsorted(unit, code, side="right") - first
        starts = np.searchsorted(number, np.arange(len(queries) + 1))
        before = np.append(0, np.cumsum(sizes))[starts]  # pairs of the queries before each query
        at = 0
        while at < len(queries):
            end = int(np.searchsorted(before, before[at] + _PAIRS, side="right")) - 1
            end = min(max(end, at + 1), at + max(1, _CELLS // len(posts)), len(queries))
            rows = slice(starts[at], starts[end])
            some, pairs = sizes[rows], int(before[end] - before[at])
            own = np.repeat(np.arange(rows.start, rows.stop), some)
            pair = np.arange(pairs) - np.repeat(np.cumsum(some) - some, some) + first[own]
            cell, shape = (number[own] - at) * len(posts) + place[pair], (end - at, len(posts))

            def times(chosen: np.ndarray) -> np.ndarray:
                return np.bincount(cell[chosen[own]], minlength=shape[0] * shape[1]).reshape(shape)

            least = needed[at:end, None]
            matched = times(bit >= 0) == least
            matched &= (least > 0) | (times(kind == SHOULD) > 0)
            matched &= times(kind == MUST_NOT) == 0
            query, post = np.nonzero(matched)
            counted = np.where(kind[own] == MUST_NOT, 0.0, weight[pair])
            latest = np.full(shape[0] * shape[1], unknown)
            np.maximum.at(latest, cell, date[pair])
            chosen = query * len(posts) + post
            parts = (queries[at + query], posts[post], latest[chosen], np.bincount(cell, counted, shape[0] * shape[1])[chosen])
            for column, part in zip(found, parts):
                column.append(part)
            at = end
    columns = [np.concatenate(parts) if parts else np.empty(0) for parts in found]
    arrays = [pa.array(column, kind) for column, kind in zip(columns, types)]
    if len(columns[2]):
        arrays[2] = pa.array(columns[2], pa.int64(), mask=columns[2] == np.iinfo(np.int64).min)
    return pa.Table.from_arrays(arrays, names=names)


def index_for(posts: DataFrame, threads: DataFrame, units: Units, span: int = keyword_index.SPAN) -> KeywordIndex:
    """An index for these units alone, made from the texts."""
    return keyword_index.build(posts, threads, units.asked(), span)


def matches(index: KeywordIndex, units: Units) -> DataFrame:
    """Every post that satisfies the clauses of a query, with its relevance: ``query_id, post_id, date, relevance``.

    Required clauses (``must``, ``phrase``, ``prefix``) must all be met and no ``must_not`` clause may; without a required
    clause one ``should`` clause is enough. Words and word starts count in either field, a phrase within one field. The
    relevance adds BM25 weights of words and phrases, titles boosted, and for a word start the boost of each field that has
    such a word. A phrase weighs as a word whose rareness is the sum over its words.
    """
    search = Search(index, units)
    return search.scores(materialize(search.spans().select("query_id", "span")))


def ranked(index: KeywordIndex, units: Units, queries: DataFrame, origin: Column, first_spans: int = FIRST_SPANS) -> DataFrame:
    """The best matches of every query by relevance plus recency: ``query_id, rank, score, post_id, date``.

    Each query's best spans are scored first. If they hold as many matches as the query wants, no span whose bound is below
    the last of them is read, and no match below it goes to the ranking.
    """
    search = Search(index, units)
    limits = with_result_limit(queries).select("query_id", "max_results")
    least, largest, count = limits.agg(*[F.coalesce(f("max_results"), F.lit(0)) for f in (F.min, F.max)], F.count("*")).first()
    few = count <= BROADCAST_ROWS
    mixed = largest > 10 * max(least, 1)
    by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "span")
    spans = materialize(search.spans(origin).withColumn("place", F.row_number().over(by_bound)))
    order = [F.round("score", DECIMALS).desc(), F.col("date").desc(), F.col("post_id")]

    def best(chosen: DataFrame) -> DataFrame:
        found = search.scores(chosen.select("query_id", "span"))
        return found.withColumn("score", F.col("relevance") + scoring.recency(F.col("date"), origin)).drop("relevance")

    def top(hits: DataFrame) -> DataFrame:
        if mixed:  # one large limit must not make every query move as many rows
            hits = worth_ranking(materialize(hits), limits, "score", few=few)
        return within_own_limit(top_per_query(hits, order, largest), queries, few)

    first = materialize(top(best(spans.where(F.col("place") <= first_spans))))
    rest = spans.where(F.col("place") > first_spans)
    if rest.isEmpty():
        return first.select("query_id", "rank", "score", "post_id", "date")
    last = first.join(limits, "query_id").where(F.col("rank") == F.col("max_results")).select("query_id", F.col("score").alias("least"))
    last = _sized(last, few)
    open_spans = materialize(_beyond(rest, last, "bound"))
    others = _beyond(best(open_spans), last, "score").drop("least")
    return top(others.unionByName(first.drop("rank"))).select("query_id", "rank", "score", "post_id", "date")


def _beyond(rows: DataFrame, last: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not below the least score that their query still needs."""
    margin = 10.0**-DECIMALS
    joined = rows.join(last, "query_id", "left")
    return joined.where(F.col("least").isNull() | (F.col(value) >= F.col("least") - margin)).select(*rows.columns)
