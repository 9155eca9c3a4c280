"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint is 64 bits: a bit is set if it is set in over half of the XXH64 hashes of the text's 4-word
shingles. Two fingerprints are linked at 4 or fewer differing bits.

Candidate search. The 64 bits are cut in segments of 21, 21 and 22 bits, each read as a word of the perfect
binary Golay code [23, 12, 7]. The keys of a word are the 12-bit indices of all codewords within distance
4: one, or six if the nearest codeword is 3 away; two words at distance 2 or less always share one. By the
pigeonhole principle 4 errors leave either two segments with 2 errors or fewer in all, of which one is
whole, or no segment with more than 2 errors: so two linked fingerprints share
  - the whole of one segment and a Golay index of another (6 ordered pairs, 33 or 34 bits of key), or
  - a Golay index in each of the three segments (36 bits of key).
Nothing is lost, and a random pair shares a key with odds below 1 in 10^6.

Only distinct fingerprints are keyed, so exact copies cost nothing. Keys are dealt out in packed arrays;
each bucket returns the links of a spanning forest and never all pairs. A search drops what it has reached, so a tight
group costs little; a key with very many fingerprints is searched in five blocks of bits, of which linked
fingerprints share one whole. That parts spread fingerprints some thousandfold; it is not linear in the worst case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import join_groups, shuffle_partitions, text_slices, written
from estatelens.llm.components import connected_components

#: Words in a shingle, differing bits of a link, the seed of XXH64.
SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Low bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Bytes of keys and fingerprints that one bucket is meant to hold; fingerprints of a key that are searched at once.
BUCKET_BYTES, DIRECT = 32 << 20, 1 << 15
#: Blocks of bits in which more fingerprints of a key are searched.
BLOCKS = MAX_BITS + 1


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 without words, the whole sequence as one shingle below 4 words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(SHINGLE_WORDS, len(words)) - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: 11 bits."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight 4 or less that lead to a codeword, and how many are used."""
    by: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for error, syndrome in zip(errors.tolist(), _syndrome(errors).tolist(), strict=True):
            if weight < 4 or not by[syndrome] or by[syndrome][0].bit_count() == 3:
                by[syndrome].append(error)
    count = np.array([len(x) for x in by])
    return np.array([x + x[:1] * (6 - len(x)) for x in by], np.int64), count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of 23-bit words, and which of the six are used."""
    patterns, count = _patterns()
    syndromes = _syndrome(words.astype(np.int64))
    return (words.astype(np.int64)[:, None] ^ patterns[syndromes]) >> 11, np.arange(6) < count[syndromes][:, None]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of uint64 fingerprints, and the row of each: key = family << 40 | up to 36 bits."""
    whole = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    coded = [golay_keys(x) for x in whole]
    keys, rows = [], []
    family = 0
    for p in range(3):
        for q in range(3):
            if p != q:
                index, used = coded[q]
                key = family << 40 | whole[p][:, None] << 12 | index
                keys.append(key[used])
                rows.append(np.nonzero(used)[0])
                family += 1
    (a, ua), (b, ub), (c, uc) = coded
    for i in range(6):
        for j in range(6):
            used = (ua[:, i] & ub[:, j])[:, None] & uc
            key = family << 40 | a[:, i, None] << 24 | b[:, j, None] << 12 | c
            keys.append(key[used])
            rows.append(np.nonzero(used)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _direct(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among fingerprints: what is reached leaves the rows still searched."""
    found, left = [], prints
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            parent, reached = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
            step = max(1, (1 << 21) // len(left))
            for at in range(0, len(frontier), step):
                near = np.bitwise_count(frontier[at : at + step, None] ^ left[None, :]) <= MAX_BITS
                new = near.any(axis=0) & ~reached
                parent[new] = at + near[:, new].argmax(axis=0)
                reached |= new
            found.append((frontier[parent[reached]], left[reached]))
            frontier, left = left[reached], left[~reached]
    return found


def _in_blocks(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links enough to reach all that linked ones reach, for many fingerprints of one key.

    The bits in which any of them differ are dealt to BLOCKS blocks. MAX_BITS bits cannot lie in all of these, so linked
    fingerprints are equal in one: those equal in a block are searched together, block by block. Each search keeps a forest, fewer links than fingerprints.
    """
    found = []
    differs = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [b for b in range(64) if int(differs) >> b & 1]
    for block in range(BLOCKS):
        part = sum((prints >> np.uint64(b) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(bits[block::BLOCKS]))
        order = np.argsort(part, kind="stable")
        found += _grouped(part[order], prints[order], _direct)
    return found


def _grouped(keys: np.ndarray, prints: np.ndarray, search: Callable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of each key; keys are sorted. Short runs are compared all at once, longer ones searched."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    runs = np.diff(edge)
    short = np.repeat(runs <= 16, runs)
    found = []
    for lag in range(1, 16):
        here = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:])
        if not len(here):
            break
        near = here[np.bitwise_count(prints[here] ^ prints[here + lag]) <= MAX_BITS]
        found.append((prints[near], prints[near + lag]))
    for k in np.flatnonzero(runs > 16):
        found += search(prints[edge[k] : edge[k + 1]])
    return found


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a spanning forest of the given ones."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links, as a spanning forest, of the fingerprints that share a key."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[new], prints[new]
    found = _grouped(keys, prints, lambda group: _direct(group) if len(group) <= DIRECT else _in_blocks(group))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])], axis=1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches):
        prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints), pa.array(keys)], ["doc_id", "print", "text_key"])


def _keyed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 8192):
                prints = every[at : at + 8192]
                keys, rows = fuzzy_keys(prints)
                bucket = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                keys, owners, bucket = keys[order], prints[rows[order]], bucket[order]
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.concatenate((edge[1:], [len(bucket)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edge], pa.int64()), pa.array([keys[i:j].tobytes() for i, j in zip(edge, ends, strict=True)], pa.binary()), pa.array([owners[i:j].tobytes() for i, j in zip(edge, ends, strict=True)], pa.binary())],
                    ["bucket", "keys", "prints"],
                )

    return run


def _linked(table: pa.Table) -> pa.Table:
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    a, b = bucket_links(read("keys", np.int64), read("prints", np.uint64))
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) and text_key (the text's XXH64 as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, print long, text_key long")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print), enough to reach all that linked ones reach."""
    distinct = written(prints.select("print").distinct(), "prints")
    rows = distinct.count()
    buckets = max(shuffle_partitions(prints.sparkSession), -(-rows * 181 * 16 // BUCKET_BYTES))
    # a fingerprint is 8 bytes and becomes 3 kB of keys: deal them out by what they become
    return distinct.repartition(buckets).mapInArrow(_keyed(buckets), "bucket long, keys binary, prints binary").groupBy("bucket").applyInArrow(_linked, "a long, b long")


def _placed(prints: DataFrame) -> DataFrame:
    """By print: the number of rows n, the smallest row least (null ids last) and the component's name."""
    components = connected_components(links(prints)).toDF("print", "component")
    # copies are counted before anything is joined, so that a component weighs as many rows as it has fingerprints
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    each = prints.groupBy("print").agg(F.min(row).alias("least"), F.count("*").alias("n"))
    return each.join(components, "print", "left").withColumn("component", F.coalesce("component", "print"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest doc_id that links reach, itself included; it is null only if all ids of
    the component are. Null and empty texts, and texts without words, have fingerprint zero and are linked
    like any other; rows that repeat a doc_id get the same answer; an empty table gives no rows; other
    columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    placed = _placed(prints)
    least = placed.groupBy("component").agg(F.min("least.doc_id").alias("component_id"))
    groups = written(placed.join(least, "component").select("print", "n", "component_id"), "print-components")
    named = join_groups(prints, groups, ["print"], "n", prints.count())
    return named.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns: the smallest doc_id's, null ids last.

    A row is found by doc_id and a hash of its text; of rows that repeat both, one stays.
    """
    prints = written(fingerprints(docs), "fingerprints")
    stay = _placed(prints).groupBy("component").agg(F.min("least").alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_text"))
    found = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_text"))
    named = prints.groupBy("doc_id", "text_key").agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("_id2"), F.col("text_key").alias("_text2"), "_n")
    stay = written(stay.join(named, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2"))).select("_id", "_text", "_n"), "near-keepers")
    once = docs.join(stay.filter("_n = 1"), found, "left_semi")
    again = docs.join(stay.filter("_n > 1"), found, "left_semi").withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return once.union(again.dropDuplicates(["doc_id", "_text"]).drop("_text"))
