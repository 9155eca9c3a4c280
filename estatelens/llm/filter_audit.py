"""Filter interaction audit: what each of five filters removes at each place of each order, from lattice edges.

A document passes through a subset lattice: an edge (already applied filters, next filter) says all that a step of an
order can do to it. There are 80 edges, and every one of the 120 orders is a path of five of them. So documents are
never run through 120 orders. They are counted by (part, filters that they fail, labels), 128 kinds a part at most;
each kind contributes to the 80 edges, edges are summed by part, and the 600 steps of all orders, a fixed table, are
joined to the edges that they pass.

One pass measures the texts. Copies (filter E) are found by SHA-256 of the whole text: only digests are shuffled, texts
that occur once are not joined, and very large groups of copies are joined by a broadcast of at most 1,000 groups.

Defined results: null and empty texts have no words, so they fail A alone, and E as copies of one another; a null part is
the empty string; rows without a doc_id neither fail E nor make others fail it, and have no labels; rows that repeat a
doc_id are not copies of each other; a document with several labels is good (toxic) if one of them says so; parts
without documents, and empty tables, give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import HOT_GROUPS, text_slices, written

FILTERS = "ABCDE"
#: Limits of A, B and C, in words, percent of words and percent of code points; symbols of D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
_UPPER, _INNER = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(0x80, 0xC0))


def failed_alone(text: bytes) -> int:
    """The filters of A to D that a UTF-8 text fails, as bits from A on."""
    words = text.split()
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words), 100 * upper > MAX_UPPER_PERCENT * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << k for k, fail in enumerate(fails) if fail)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, at = batch.column(batch.schema.get_field_index("part")), 0
        for ids, texts in text_slices(iter([batch])):
            columns = [pa.array(ids, pa.int64()), parts.slice(at, len(ids)), pa.array([failed_alone(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "alone", "digest"])
            at += len(ids)


def failures(docs: DataFrame, part: str) -> DataFrame:
    """Per row of docs: doc_id, part, fails (bits from A on, E included)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    measured = written(rows.mapInArrow(_measure, "doc_id long, part string, alone int, digest binary"), "audit-rows")
    copies = written(measured.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "audit-copies")
    limit = max(1, measured.count() // HOT_GROUPS)
    # of large groups, fewer than HOT_GROUPS, the first is broadcast; rows of the others meet it by a shuffle
    large = F.broadcast(copies.filter(F.col("n") > limit).select("digest", F.col("first").alias("first_large")))
    small = copies.filter(F.col("n") <= limit).select("digest", "first")
    marked = measured.join(large, "digest", "left")
    again = lambda first: F.when(F.coalesce(F.col(first) < F.col("doc_id"), F.lit(False)), COPY).otherwise(0)
    of_large = marked.filter("first_large is not null").select("doc_id", "part", (F.col("alone") + again("first_large")).alias("fails"))
    of_rest = marked.filter("first_large is null").join(small, "digest", "left").select("doc_id", "part", (F.col("alone") + again("first")).alias("fails"))
    return of_large.unionByName(of_rest)


def kinds(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, fails, good and toxic."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id are dealt out by what they have and match nothing
    key = [F.coalesce("doc_id", F.xxhash64("part", "fails")) == F.col("label_id"), F.col("doc_id").isNotNull() == F.col("has_id")]
    named = failed.join(marks.filter("label_id is not null").withColumn("has_id", F.lit(True)), key, "left")
    return named.groupBy("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))


def lattice() -> list[tuple[int, int]]:
    """The 80 edges: (bits of the filters applied already, number of the next filter)."""
    numbers = range(len(FILTERS))
    return [(sum(1 << k for k in before), f) for f in numbers for size in numbers for before in combinations([k for k in numbers if k != f], size)]


def edges(counted: DataFrame) -> DataFrame:
    """Per part and edge (before, next): kept, removed, redundant, unique_fails, good_lost, toxic_lost."""
    every = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(f).alias("next")) for before, f in lattice()]))
    met = counted.select("*", every.alias("edge")).select("*", "edge.before", "edge.next")
    bit = F.expr("shiftleft(1, next)")
    gone, fails = F.col("fails").bitwiseAND(F.col("before")) != 0, F.col("fails").bitwiseAND(bit) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return met.groupBy("part", "before", "next").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"),
        total(~gone & fails & (F.col("good") == 1)).alias("good_lost"),
        total(~gone & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def steps() -> list[tuple[str, int, int, int]]:
    """The 600 steps of all orders: (filter_order, step from 1, before, next)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        out += [(name, k + 1, sum(1 << x for x in order[:k]), f) for k, f in enumerate(order)]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    summed = written(edges(kinds(failures(docs, part), labels)), "audit-edges")
    # an edge lies on as many orders as there are ways to sort what stands before it and what comes after it
    n = len(FILTERS)
    size = F.bit_count("before")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), size + 1)
    shapley = summed.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    path = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, before int, next int"))
    out = summed.join(shapley, ["part", "next"]).join(path, ["before", "next"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
