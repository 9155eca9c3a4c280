"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index. Documents are dealt out by row and written as postings (row, pos, term_id), in buckets by row and sorted
by term within a bucket, so that the list of a term is contiguous in each bucket, and documents meet what is found in
them without moving again. Only terms of the tests have lists: no other list could be read. A row's first posting is a
header of term HEADER with its doc_id and number of words.

Exact phrases. The windows of the test items are looked up by their rarest terms: the lists of the rarest and of the second
rarest term of a window, each less the term's offset in the item, are intersected; what is left are
diagonals (row, item, pos - offset), few besides true ones. The other terms are then read from the lists of the rows
that are left, and runs of matching offsets as long as a window are the exact matches. Proximity matches intersect
in the same order, with places that may be up to a slop apart.

Sizes. The tests' vocabulary is broadcast up to VOCABULARY_BROADCAST terms; a larger one is joined by shuffling. All else is
left to Spark, which sees the sizes of written tables. A passage in a third of all rows adds as many rows as it has
places; nothing is paired within a group. Lists of very frequent terms are spread over all buckets.

Defined results: null and empty texts have no words and no hits; items without words have no windows; items with
fewer words than a window are one window; items that repeat an item_id are one item with the windows of all; a null
item_id stands as the empty string among the item_ids; rows that repeat a doc_id are each a document; very long texts
are read whole; an empty table gives no rows; other columns are ignored. docs must give the same rows in the same
order when it is read again, as a stored table does.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import bucketed, shuffle_partitions, written

WINDOW = 10
#: The list of headers; terms of the tests have numbers from 0.
HEADER = -1
#: Terms of the tests that may be broadcast, some tens of bytes each.
VOCABULARY_BROADCAST = 500_000
#: Fixed value: what stands between words. A to Z count as words and are lower-cased after the split.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A to Z in lower case and nothing else changed; words of ASCII letters take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


@dataclass(frozen=True)
class Index:
    """postings: row, pos, term_id, and in headers doc_id and n_words; tokens: item, off, size, term_id of the tests; items: item, item_id."""

    postings: DataFrame
    tokens: DataFrame
    items: DataFrame

    def headers(self) -> DataFrame:
        return self.postings.filter(F.col("term_id") == HEADER).select("row", "doc_id", "n_words")

    def lists(self) -> DataFrame:
        return self.postings.filter(F.col("term_id") >= 0).select("row", "pos", "term_id")


def build_index(docs: DataFrame, tests: DataFrame, vocabulary_broadcast: int = VOCABULARY_BROADCAST) -> Index:
    """The index of docs (doc_id, text) for the terms of tests (item_id, text)."""
    said = tests.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    items = written(said.filter(F.size("words") > 0), "items")
    spoken = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("off", "word")).select("item", "off", "size", lowered(F.col("word")).alias("term"))
    vocabulary = written(spoken.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    tokens = written(spoken.join(vocabulary, "term").select("item", "off", "size", "term_id"), "item-tokens")
    known = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(HEADER).cast("long").alias("term_id")))
    n = shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(n, "row")
    split = dealt.select("row", "doc_id", words(F.col("text")).alias("words"))
    # position 0 is the header
    each = split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    named = each.select("row", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"), (F.col("pos") - 1).alias("pos"), lowered(F.col("word")).alias("term"))
    if vocabulary.count() <= vocabulary_broadcast:
        postings = named.join(F.broadcast(known), "term")
    else:
        postings = named.join(known.hint("merge"), "term").repartition(n, "row")
    postings = bucketed(postings.select("row", "pos", "term_id", "doc_id", "n_words"), "positions", n, "row", ["term_id", "row", "pos"])
    return Index(postings, tokens, items)


def _ranked(index: Index) -> DataFrame:
    """Per item: tokens, an array of (n, off, term_id), in order of place; n is how often the term stands in the documents."""
    often = index.lists().groupBy("term_id").agg(F.count("*").alias("n"))
    counted = index.tokens.join(often, "term_id", "left")
    token = F.struct("off", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "term_id")
    return counted.groupBy("item", "size").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def _windows(index: Index, window: int) -> DataFrame:
    """Per window of an item of which every term occurs: item, start, wide, and offset and term of its rarest two (o1, t1, o2, t2)."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - window)))
    wide = F.least(F.lit(window), F.col("size"))
    cut = _ranked(index).select("item", "tokens", wide.alias("wide"), starts.alias("start"))
    by_count = F.sort_array(F.transform(F.slice("tokens", F.col("start") + 1, F.col("wide")), lambda t: F.struct(t["n"].alias("n"), t["off"].alias("off"), t["term_id"].alias("term_id"))))
    rarest = cut.select("item", "start", "wide", by_count.alias("r")).filter(F.col("r")[0]["n"] > 0)
    return rarest.select("item", "start", "wide", F.col("r")[0]["off"].alias("o1"), F.col("r")[0]["term_id"].alias("t1"), F.get("r", F.lit(1))["off"].alias("o2"), F.get("r", F.lit(1))["term_id"].alias("t2"))


def _adjusted(index: Index, wanted: DataFrame, off: str, term: str) -> DataFrame:
    """The lists of wanted terms, less their offsets: row, item, off, diagonal."""
    asked = wanted.filter(F.col(term).isNotNull()).select("item", F.col(off).alias(off), F.col(term).alias("term_id")).distinct()
    return index.lists().join(asked, "term_id").select("row", "item", off, (F.col("pos") - F.col(off)).alias("diagonal"))


def _of_rows(index: Index, rows: DataFrame) -> DataFrame:
    """The lists of these rows only. The postings are in buckets by row and do not move."""
    return index.lists().join(rows.hint("shuffle_hash"), "row", "left_semi")


def phrase_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """Exact matches, joined where they overlap on one diagonal: row, item, first and last (positions in the document)."""
    windows = written(_windows(index, window), "windows")
    first, second = _adjusted(index, windows, "o1", "t1"), _adjusted(index, windows, "o2", "t2")
    pairs = windows.select("item", "o1", "o2").distinct()
    met = first.join(second, ["row", "item", "diagonal"]).join(pairs, ["item", "o1", "o2"], "left_semi")
    alone = first.join(windows.filter("t2 is null").select("item", "o1").distinct(), ["item", "o1"], "left_semi").withColumn("o2", F.lit(None).cast("int"))
    left = written(met.select("row", "item", "diagonal", "o1", "o2").union(alone.select("row", "item", "diagonal", "o1", "o2")), "diagonals")
    # the other offsets of the windows that are left
    choice = windows.select("item", "o1", F.coalesce("o2", F.lit(-1)).alias("o2"), "start", "wide")
    spans = left.withColumn("o2", F.coalesce("o2", F.lit(-1))).join(choice, ["item", "o1", "o2"])
    offsets = spans.select("row", "item", "diagonal", "wide", F.explode(F.sequence("start", F.col("start") + F.col("wide") - 1)).alias("off")).distinct()
    asked = offsets.join(index.tokens.select("item", "off", "term_id"), ["item", "off"]).withColumn("pos", F.col("diagonal") + F.col("off"))
    found = _of_rows(index, left.select("row").distinct()).join(asked, ["row", "pos", "term_id"]).select("row", "item", "diagonal", "wide", "off")
    island = F.col("off") - F.row_number().over(Window.partitionBy("row", "item", "diagonal").orderBy("off"))
    runs = found.withColumn("island", island).groupBy("row", "item", "diagonal", "wide", "island").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    return runs.filter(F.col("b") - F.col("a") + 1 >= F.col("wide")).select("row", "item", (F.col("diagonal") + F.col("a")).alias("first"), (F.col("diagonal") + F.col("b")).alias("last"))


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """Places where all terms of an item stand at most slop words from where they would stand around its rarest term.

    Gives row, item, diagonal (where the item would begin) and spread, the largest such distance.
    """
    ranked = _ranked(index).select("item", "size", F.sort_array(F.transform("tokens", lambda t: F.struct(t["n"].alias("n"), t["off"].alias("off"), t["term_id"].alias("term_id")))).alias("r")).filter(F.col("r")[0]["n"] > 0)
    chosen = written(ranked.select("item", "size", F.col("r")[0]["off"].alias("o1"), F.col("r")[0]["term_id"].alias("t1"), F.get("r", F.lit(1))["off"].alias("o2"), F.get("r", F.lit(1))["term_id"].alias("t2")), "rarest")
    cell = lambda diagonal: F.floor(diagonal / (slop + 1)).cast("int")
    near = lambda a, b: F.abs(a - b) <= slop
    around = F.explode(F.array(*[cell(F.col("diagonal")) + k for k in (-1, 0, 1)]))
    first = _adjusted(index, chosen, "o1", "t1").select("row", "item", "diagonal")
    second = _adjusted(index, chosen, "o2", "t2").select("row", "item", F.col("diagonal").alias("other"), cell(F.col("diagonal")).alias("cell"))
    met = first.withColumn("cell", around).join(second, ["row", "item", "cell"]).filter(near(F.col("diagonal"), F.col("other")))
    single = first.join(chosen.filter("t2 is null").select("item"), "item", "left_semi")
    left = written(met.select("row", "item", "diagonal").union(single.select("row", "item", "diagonal")).distinct(), "near-places")
    placed = _of_rows(index, left.select("row").distinct()).join(index.tokens, "term_id").select("row", "item", "off", "size", (F.col("pos") - F.col("off")).alias("other"))
    met = left.withColumn("cell", around).join(placed.withColumn("cell", cell(F.col("other"))), ["row", "item", "cell"]).filter(near(F.col("diagonal"), F.col("other")))
    least = met.groupBy("row", "item", "size", "diagonal", "off").agg(F.min(F.abs(F.col("diagonal") - F.col("other"))).alias("apart"))
    whole = least.groupBy("row", "item", "size", "diagonal").agg(F.count("*").alias("n"), F.max("apart").alias("spread"))
    return whole.filter(F.col("n") == F.col("size")).select("row", "item", "diagonal", "spread")


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs, tests)
    matches = written(phrase_matches(index, window), "matches")
    # a word counts once, however many matches cover it
    before = F.max("last").over(Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(-1))))
    hits = matches.select("row", "first", "last").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = matches.select("row", "item").distinct().join(index.items.select("item", "item_id"), "item").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = index.headers().join(hits.join(named, "row"), "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
