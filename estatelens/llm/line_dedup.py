"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line is the set of its character shingles of SHINGLE characters (UTF-16 units; a shorter line is one shingle). Two
lines are near-duplicates at a Jaccard similarity of SIMILARITY or more; of each component of near-duplicate
lines one stays, the one that comes first by document and place.

Signatures. Copies of a line are one node, told apart by two hashes. The shingles of a node are exploded and hashed
in generated code; the top bits of a hash name one of BANDS * ROWS bins, and the least hash of each bin is a
MinHash value (one permutation). In a line of n shingles only hashes below a share of a bin's range can be its least,
so that PER_BIN of them are expected there; that bound moves smoothly with n, so like lines have like bounds. All
nodes get BANDS keys of ROWS bins each: two lines of similarity 0.8 share a band with odds of 99.4 %, of 0.9 with
99.98 %. Nodes that share a band get a longer signature of BINS bins.

Candidates. In bands of at most FEW nodes all are held against each other. A larger band chooses HUBS hubs that stand amid
its nodes; a node is held against the hubs of its bands that most bins agree with, one a draw. Links join components.
What is still outside the main component of a larger band, if at most SMALL nodes, is then held against the whole band.
Of bands with more such nodes, a node of which more than a fifth of the shingles stand in no other node of such bands
has no link there and leaves; where still more than SMALL are outside, all get longer keys in more bands (FINER), which
part unlike variants of one passage, and go through the same steps. There the shingles of each node's own refuse pairs
that surely are unlike. Only what even the longest keys leave together is compared whatever the size. Nodes that agree in
fewer than AGREE bins are no candidates, which loses 1 pair in 200 at similarity 0.8. Every link is verified by the
Jaccard similarity over all shingles.

Defined results: null and empty texts are one blank line; blank lines (white space only) are kept and have
no component; rows that repeat a doc_id are marked alike; null ids come first; an empty table gives no rows;
other columns are ignored, or kept by drop_repeated_lines().
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import dropped, shuffle_partitions, written
from estatelens.llm.components import connected_components

SHINGLE, SIMILARITY = 12, 0.8
#: Bytes of a shingle.
WIDTH = 2 * SHINGLE
#: Bands of all nodes and bins of a key; bins of the longer signature of nodes that share a band.
BANDS, ROWS, BINS = 5, 2, 32
#: Hashes of a line that are expected to compete for a bin.
PER_BIN = 3
#: Bins that two candidates agree in at least.
AGREE = 20
#: Hubs of a band, and nodes outside its main component that are held against all of it.
HUBS, SMALL = 3, 100
#: Nodes of a band that are all compared with each other, without hubs.
FEW = 8
#: Lines of a task that counts shingles.
DEALT = 100
#: Nodes of a band that are drawn to tell which of it stand in its middle.
DRAWS = 6
#: Bins in a key, and keys of a node, for the nodes of larger bands: at similarity 0.8 two share a key with odds of 98.8 and 98.6 %.
FINER = ((8, 24), (12, 60))

#: Bits of a MinHash value that a lane keeps; a long holds 8 lanes of a byte each.
_LANE = 6
LANES = [f"lane{k}" for k in range(BINS // 8)]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(line: Column) -> Column:
    """Hashes of all shingles of a line, in order; fixed-width characters make each a slice of bytes."""
    last = lambda wide: F.greatest(F.lit(1), F.octet_length(wide) - WIDTH + 1)
    return _let(F.encode(line, "UTF-16BE"), lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(2)), lambda i: F.xxhash64(F.substr(wide, i, F.lit(WIDTH)))))


def signatures(texts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Per node of texts (keys, line): keys and m0, m1 ..., the least hash of each of some bins, null for an empty bin.

    Hashes are dealt over the next power of two; the ranges beyond the bins join the first of them.
    """
    top = (bins - 1).bit_length()
    wide = texts.select(*keys, F.encode("line", "UTF-16BE").alias("wide"))
    sized = wide.select("*", F.greatest(F.lit(1), F.octet_length("wide") - WIDTH + 1).alias("last"))
    # a share of a bin's range: a number of the 63 - top bits that follow the bin's own
    full = float(1 << (63 - top))
    bound = F.least(F.lit(full), F.lit(full * (PER_BIN << top) * 2) / (F.col("last") + 1)).cast("long")
    each = sized.select(*keys, "wide", bound.alias("bound"), F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2))).alias("i"))
    hashed = each.select(*keys, "bound", F.xxhash64(F.substr("wide", "i", F.lit(WIDTH))).alias("h"))
    which = F.shiftrightunsigned("h", 64 - top) % bins
    low = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit((1 << (64 - top)) - 1)), 1) < F.col("bound")
    return hashed.filter(low).groupBy(*keys).agg(*[F.min(F.when(which == b, F.col("h"))).alias(f"m{b}") for b in range(bins)])


def band_keys() -> Column:
    """The band keys of a node with signature: one for each band that has a value."""

    def key(band: int) -> Column:
        own = [F.col(f"m{k}") for k in range(band * ROWS, (band + 1) * ROWS)]
        return F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(band), *own))

    return F.array_compact(F.array(*[key(b) for b in range(BANDS)]))


def lanes() -> list[Column]:
    """The low bits of all bins, 8 in a long; an empty bin counts as a value."""
    packed = []
    for at in range(0, BINS, 8):
        word = F.lit(0).cast("long")
        for k in range(8):
            low = F.coalesce(f"m{at + k}", F.lit(0)).bitwiseAND(F.lit((1 << _LANE) - 1))
            word = word.bitwiseOR(F.call_function("shiftleft", low, F.lit(8 * k)))
        packed.append(word.alias(LANES[at // 8]))
    return packed


def agreement(a: list[Column], b: list[Column]) -> Column:
    """In how many bins two nodes agree: a lane that differs carries into the bit above its own."""
    low, carry = int("3f" * 8, 16), int("40" * 8, 16)
    apart = [F.bit_count((x.bitwiseXOR(y) + F.lit(low)).bitwiseAND(F.lit(carry))) for x, y in zip(a, b, strict=True)]
    return F.lit(BINS) - sum(apart[1:], apart[0])


def finer_keys(size: int, count: int) -> Column:
    """count keys of a node, each of size bins drawn by a fixed seed."""
    rng, keys = random.Random(size), []
    for k in range(count):
        mask = [0] * len(LANES)
        for b in rng.sample(range(BINS), size):
            mask[b // 8] |= (1 << _LANE) - 1 << 8 * (b % 8)
        keys.append(F.xxhash64(F.lit(size * 1000 + k), *[F.col(n).bitwiseAND(F.lit(m)) for n, m in zip(LANES, mask, strict=True) if m]))
    return F.array(*keys)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _filled() -> Column:
    return F.col("line").rlike(r"[^\x20\x09-\x0D]")


def _hashes() -> list[Column]:
    """Two hashes that tell lines apart; null for blank lines."""
    return [F.when(_filled(), F.xxhash64("line")).alias("h1"), F.when(_filled(), F.xxhash64(F.lit("twin"), F.col("line"))).alias("h2")]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are similar enough; texts: node, line."""
    both = pairs.join(texts.toDF("a", "la"), "a").join(texts.toDF("b", "lb"), "b")
    sets = both.select("a", "b", F.array_distinct(shingle_hashes(F.col("la"))).alias("xa"), F.array_distinct(shingle_hashes(F.col("lb"))).alias("xb"))
    sized = sets.select("a", "b", (F.size("xa") + F.size("xb")).alias("sizes"), F.size(F.array_intersect("xa", "xb")).alias("same"))
    return sized.filter(F.col("same") >= SIMILARITY * (F.col("sizes") - F.col("same"))).select("a", "b")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (node, key) whose key several nodes have, with size, their number."""
    # dealt once by key; the aggregate and the join both use that exchange, and the join hashes the few keys that are shared
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key")
    keys = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low < high")
    return dealt.join(keys.select("key", "size").hint("shuffle_hash"), "key")


def _with(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows with component, the node itself if it has no link yet."""
    return rows.withColumn("component", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _tested(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The different pairs, the smaller node first, without those before."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return written(ordered if before is None else ordered.join(before, ["a", "b"], "left_anti"), "pairs")


def _joined(labels: DataFrame | None, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """labels with the verified links of pairs; the stars of labels are links too."""
    new = verified(pairs, texts)
    out = written(connected_components(new if labels is None else new.union(labels.filter("node <> component").toDF("a", "b"))), "labels")
    dropped(labels)
    return out


def _own_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes with n, their shingles, and own, those that no other of these nodes has; nodes without any possible link go."""
    # a task gets as many lines however many there are
    wide = nodes.join(texts, "node").select("node", F.encode("line", "UTF-16BE").alias("wide")).repartition(-(-nodes.count() // DEALT), "node")
    last = F.greatest(F.lit(1), F.octet_length("wide") - WIDTH + 1)
    each = wide.select("node", "wide", F.explode(F.sequence(F.lit(1), last, F.lit(2))).alias("i")).select("node", F.xxhash64(F.substr("wide", "i", F.lit(WIDTH))).alias("h"))
    of_one = each.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    own = of_one.groupBy("node").agg(F.count("*").alias("own"))
    sized = nodes.join(texts, "node").withColumn("n", F.size(F.array_distinct(shingle_hashes(F.col("line"))))).drop("line")
    counted = sized.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return counted.filter(F.col("n") - F.col("own") >= SIMILARITY * F.col("n"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
    """rows as a and as b, in how many bins a and b agree, and whether they are candidates.

    Similar nodes share at least SIMILARITY of all their shingles; what is a node's own is not shared, so the
    smaller remainder bounds what they share, and either with the other's own what they have together.
    """
    carried = [c for c in (*LANES, "n", "own") if c in rows.columns]
    a, b = (rows.select("key", F.col("node").alias(s), F.col("component").alias(f"c{s}"), *[F.col(n).alias(s + n) for n in carried]) for s in "ab")
    agreed = agreement([F.col("a" + n) for n in LANES], [F.col("b" + n) for n in LANES])
    may = (F.col("ca") != F.col("cb")) & (agreed >= AGREE)
    if "own" in carried:
        n, own = (lambda s: F.col(s + "n")), (lambda s: F.col(s + "own"))
        shared = F.least(n("a") - own("a"), n("b") - own("b"))
        may = may & (shared >= SIMILARITY * F.greatest(n("a") + own("b"), n("b") + own("a")))
    return a, b, agreed, may


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each node with at most HUBS hubs: of the hubs of its bands, by draw, the one that most bins agree with.

    A band draws HUBS nodes; for each, that one of its candidates, or itself, becomes a hub which agrees most with all of
    DRAWS draws. Such a node stands amid the variants of a passage, where one drawn at random may have no link at all.
    """
    a, b, agreed, may = _sides(rows)
    drawn = b.groupBy("key").agg(*[F.min_by(F.struct(*[F.col("b" + n).alias(n) for n in LANES]), F.xxhash64("b", F.lit(k))).alias(f"draw{k}") for k in range(DRAWS)])
    own = [F.col("b" + n) for n in LANES]
    met = b.join(drawn, "key").select("key", F.struct(*b.columns[1:]).alias("hub"), *[agreement(own, [F.col(f"draw{k}")[n] for n in LANES]).alias(f"met{k}") for k in range(DRAWS)])
    scored = met.withColumn("score", sum([F.col(f"met{k}") for k in range(1, DRAWS)], F.col("met0")))
    best = scored.groupBy("key").agg(*[F.max_by("hub", F.when(F.col(f"met{k}") >= AGREE, F.col("score"))).alias(f"hub{k}") for k in range(HUBS)])
    hubs = best.select("key", F.posexplode(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("draw", "hub")).select("key", "draw", "hub.*")
    near = a.join(hubs, "key").filter(may).select("a", "draw", "b", agreed.alias("agreed"))
    return near.groupBy("a", "draw").agg(F.max_by("b", "agreed").alias("b")).select("a", "b")


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of bands that still have several components, with main, the component of most nodes, and rest, the number of the others."""
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("of"))
    bands = counts.groupBy("key").agg(F.max_by("component", "of").alias("main"), (F.sum("of") - F.max("of")).alias("rest")).filter("rest > 0")
    return rows.drop("main", "rest").join(bands, "key")


def _rest_pairs(rows: DataFrame) -> DataFrame:
    """Each node outside the main component of a band with all candidates of the band."""
    a, _, _, may = _sides(rows.filter("component <> main"))
    _, b, _, _ = _sides(rows)
    return a.join(b, (a["key"] == b["key"]) & may).select("a", "b")


def _link(rows: DataFrame, texts: DataFrame, labels: DataFrame | None = None, finer: tuple = FINER) -> DataFrame:
    """labels with the links within bands: rows are key, size, node, lanes and, in finer bands, n and own."""
    placed = _with(labels, rows)
    a, b, _, may = _sides(placed.filter(F.col("size") <= FEW))
    few = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & may).select("a", "b")
    first = _tested(few.union(_hub_pairs(placed.filter(F.col("size") > FEW))))
    labels = _joined(labels, first, texts)
    open_ = written(_apart(_with(labels, rows.filter(F.col("size") > FEW))), "open-bands")
    large = open_.filter(F.col("rest") > SMALL)
    nodes = beyond = None
    pairs = _rest_pairs(open_.filter(F.col("rest") <= SMALL))
    if not large.isEmpty():
        if "own" not in large.columns:
            nodes = written(_own_shingles(large.select("node").distinct(), texts), "own-shingles")
            large = large.join(nodes, "node")
        large = written(_apart(large), "large-bands")
        pairs = pairs.union(_rest_pairs(large.filter(F.col("rest") <= SMALL) if finer else large))
        beyond = large.filter(F.col("rest") > SMALL).select("node", *LANES, "n", "own").distinct() if finer else None
    second = _tested(pairs, first)
    labels = _joined(labels, second, texts)
    if beyond is not None and not beyond.isEmpty():
        keys = beyond.select("node", F.explode(finer_keys(*finer[0])).alias("key"))
        labels = _link(written(_shared(keys).join(beyond, "node"), "finer-bands"), texts, labels, finer[1:])
    for table in (first, second, open_, nodes, large):
        dropped(table)
    return labels


def near_duplicate_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, h1, h2) of the filled lines that share a band, and (node, component) of those with a link."""
    lines = _lines(docs).filter(_filled()).select(*_hashes(), "line")
    # copies of a line have one signature, so they meet in the aggregate of it and no text is shuffled
    signed = signatures(lines, ["h1", "h2"], BANDS * ROWS)
    nodes = written(signed.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", band_keys().alias("keys")), "nodes")
    bands = written(_shared(nodes.select("node", F.explode("keys").alias("key"))), "shared-bands")
    wanted = written(bands.select("node").distinct().join(nodes.select("node", "h1", "h2"), "node"), "wanted")
    dropped(nodes)
    texts = written(lines.join(wanted.hint("shuffle_hash"), ["h1", "h2"]).groupBy("node").agg(F.first("line").alias("line")), "texts")
    rows = written(bands.join(signatures(texts, ["node"], BINS).select("node", *lanes()), "node"), "signed-bands")
    dropped(bands)
    labels = _link(rows, texts)
    for table in (rows, texts):
        dropped(table)
    return wanted, labels


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per line: doc_id, line_no, line_id (hex), component_id (hex; the least line_id of the component), kept."""
    nodes, labels = near_duplicate_nodes(docs)
    linked = labels.join(nodes, "node")
    name = linked.groupBy("component").agg(F.min(F.struct("h1", "h2")).alias("name"))
    fuzzy = written(linked.join(name, "component").select("h1", "h2", F.col("name.h1").alias("c1"), F.col("name.h2").alias("c2")), "fuzzy")
    dropped(nodes)
    dropped(labels)
    placed = _lines(docs).select("doc_id", "line_no", *_hashes()).join(fuzzy.hint("shuffle_hash"), ["h1", "h2"], "left")
    placed = written(placed.select("doc_id", "line_no", "h1", "h2", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2")), "placed-lines")
    dropped(fuzzy)
    # joined by place, not by component: no large component meets in one task
    first = placed.filter("c1 is not null").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "line_no")).alias("f"))
    first = first.select(F.col("c1").alias("f1"), F.col("c2").alias("f2"), F.col("f.doc_id").alias("f_doc"), F.col("f.line_no").alias("f_line"))
    same = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("line_no") == F.col("f_line")) & (F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2"))
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    kept = F.col("c1").isNull() | F.col("f1").isNotNull()
    return placed.join(first, same, "left").select("doc_id", "line_no", name("h1", "h2").alias("line_id"), name("c1", "c2").alias("component_id"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with only the lines that stay in text; all other columns as they are."""
    gone = line_dedup(docs).filter(~F.col("kept")).groupBy("doc_id").agg(F.collect_set("line_no").alias("_dropped"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_dropped"), i))
    joined = docs.join(gone.withColumnRenamed("doc_id", "_dropped_from"), docs["doc_id"].eqNullSafe(F.col("_dropped_from")), "left")
    return joined.select(*[F.when(F.col("_dropped").isNull(), docs["text"]).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns])
