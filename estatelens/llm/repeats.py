"""Removal of repeated byte strings by blockwise, difference-cover suffix sorting.

Every byte that a 100-byte string covers which also starts earlier in the corpus goes. The suffixes (here
100-byte windows, as no longer prefix matters) are sorted one bucket at a time, and only suffixes that can
have an equal are sorted at all:

1. Buckets. The anchor of a window is the 24-byte string in it with the smallest hash, the first of equal
   ones. It depends on the window's bytes alone, so equal windows have equal anchors at equal places: an
   anchor's hash is a suffix bucket. The windows of one anchor occurrence are neighbours; together they are
   one context of at most 176 bytes. Occurrences go out packed in arrays, dealt by anchor hash. A task sends
   only its first occurrence of each context and settles the others itself, so a passage or document that a
   third of the corpus repeats leaves a task once.
2. Classes. Occurrences of one context (128 bits of hashes) form a class; all but its first go. Where a bucket
   has one class, that is all. Where it has several, the first of each class is a suffix set to be sorted.
3. Sorting. The contexts of a bucket stand in a block as rows with their anchors in one column. Ranks of the
   columns of a difference cover modulo 16 are precomputed to depth 64 by doubling. Then one start column
   at a time is sorted by its first 16 bytes; long ties are resolved by the ranks of the cover sample that
   the start column and its equals share, and the tail that no sample reaches by its bytes. Equal windows
   but the first go. Memory is a block of rows, whatever the corpus.
   A bucket with more than MANY classes (the edge of a very common passage) is dealt again by the bytes of
   single windows, with equal windows of a task settled by the task as in step 1.
4. What goes is joined to the documents and cut out.

Defined results: null text counts as empty; texts shorter than 100 bytes stay whole; rows that repeat a
doc_id with the same text get the same answer (neither starts earlier than the other); null ids come after
all others and are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import shuffle_partitions, text_slices, written

#: Bytes of a repeated string, of an anchor; anchors in a window.
LENGTH, ANCHOR = 100, 24
ANCHORS = LENGTH - ANCHOR + 1
#: Classes of a bucket that are sorted in one block; rows of a block.
MANY, BLOCK_ROWS = 2000, 16384
#: Bytes of texts whose anchors a task gathers before it sends them.
GATHERED = 64 << 20
#: Modulus of the difference cover: a square. Its members: the first root and every root-th from there.
MODULUS, ROOT = 16, 4
COVER = tuple(sorted({*range(ROOT), *range(2 * ROOT - 1, MODULUS, ROOT)}))
#: Column of the anchors in a block, and columns of a row: a multiple of the modulus each.
CENTRE, WIDTH = 80, 192
#: Stands for a null id.
LAST_ID = (1 << 63) - 1


def cover_shift(a: int, b: int) -> int:
    """The least d for which a + d and b + d are both in the cover, modulo MODULUS; it always exists."""
    return next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as unsigned numbers (a view)."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    w = _words(data)
    n = len(data) - ANCHOR + 1
    x = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x += w[16 : n + 16] * np.uint64(0x165667B19E3779F9)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of size neighbours: blocks of that size, minima from both their ends."""
    n = len(x) - size + 1
    blocks = np.full(-(-len(x) // size) * size, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor occurrences of texts: text number, first window, anchor - first, last - first, two hashes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join([*texts, b"\0" * 8]), np.uint8)
    n = len(data) - 8
    if n < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    hashes = _anchor_hashes(data[:n])
    # high bits of the hash, then the place: the minimum is the smallest hash, the first of equal ones
    place = np.uint64((1 << 26) - 1)
    least = _window_minima(hashes & ~place | np.arange(len(hashes), dtype=np.uint64), ANCHORS)
    anchor = (least & place).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(anchor)] == owner[LENGTH - 1 : LENGTH - 1 + len(anchor)]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    at, whose = anchor[starts], owner[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (whose[1:] != whose[:-1]))))
    first = starts[new]
    last = starts[np.concatenate((new[1:], [len(starts)])) - 1]
    buffer, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(buffer[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return whose[new], first - begin[whose[new]], at[new] - first, last - first, hashes[at[new]], context


def _parts(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Texts in groups that occurrences() can place; a very long one in overlapping pieces with their starts."""
    most = 32 << 20
    group: tuple[list, list[int], list[bytes]] = ([], [], [])
    held = 0
    for doc_id, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), most):
            piece = text[at : at + most + LENGTH - 1]
            if held and held + len(piece) > most:
                yield group
                group, held = ([], [], []), 0
            for column, value in zip(group, (LAST_ID if doc_id is None else doc_id, at, piece), strict=True):
                column.append(value)
            held += len(piece)
    if group[0]:
        yield group


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts, joined where they overlap or touch in one document."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    # within a document the furthest last so far; documents are told apart by a large step
    step = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(last.max()) + 3)
    reach = np.maximum.accumulate(last + step)
    new = np.flatnonzero(np.concatenate(([True], first[1:] + step[1:] > reach[:-1] + 1)))
    ends = np.concatenate((new[1:], [len(doc)])) - 1
    return doc[new], first[new], reach[ends] - step[ends]


_SENT = "bucket long, gone boolean, doc binary, first binary, left binary, span binary, anchor binary, context binary"


def _packed(bucket: np.ndarray, gone: bool, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with the bytes of each column."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    runs = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    blobs = [pa.array([c[a:b].tobytes() for a, b in runs], pa.binary()) for c in columns] + [pa.array([b""] * len(runs), pa.binary())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int64()), pa.array([gone] * len(runs)), *blobs], [x.split()[0] for x in _SENT.split(", ")])


def _spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def settled(keys: tuple[np.ndarray, ...], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order by keys, document and place, and whether each is a first of its keys there."""
    order = np.lexsort((first, doc, *keys))
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    head = np.concatenate(([True], ~same)) if len(order) else same
    at = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    # a row that repeats a first's document and place is a first too
    lead = (doc[order] == doc[order][at]) & (first[order] == first[order][at])
    return order, lead


def _gather(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            doc, first, left, span, anchor, context = (np.concatenate(c) for c in zip(*held, strict=True))
            order, lead = settled((context, anchor), doc, first)
            there, here = order[lead], order[~lead]
            narrow = [doc[there], first[there].astype(np.int64), left[there].astype(np.uint8), span[there].astype(np.uint8), anchor[there], context[there]]
            yield _packed(_spread(anchor[there], buckets), False, narrow)
            d, a, b = merged(doc[here], first[here], first[here] + span[here])
            yield _packed(_spread(d, buckets), True, [d, a.astype(np.int64), b.astype(np.int64)])
            held.clear()

        for ids, texts in text_slices(batches):
            for owners, begins, pieces in _parts(ids, texts):
                whose, first, *rest = occurrences(pieces)
                held.append((np.array(owners, np.int64)[whose], first + np.array(begins, np.int64)[whose], *rest))
                size += sum(map(len, pieces))
            if size > GATHERED:
                yield from sent()
                size = 0
        if held:
            yield from sent()

    return run


_DECIDED = "gone boolean, doc long, first long, last long, left int, anchor long, many boolean"


def _decided(gone: bool, doc: np.ndarray, first: np.ndarray, last: np.ndarray, left: np.ndarray | None = None, anchor: np.ndarray | None = None, many: np.ndarray | None = None) -> pa.Table:
    n = len(doc)
    put = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind)
    columns = [pa.array(np.full(n, gone)), put(doc, pa.int64()), put(first, pa.int64()), put(last, pa.int64()), put(left, pa.int32()), put(None if anchor is None else anchor.view(np.int64), pa.int64()), put(many, pa.bool_())]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in _DECIDED.split(", ")])


def _classes(table: pa.Table) -> pa.Table:
    """One bucket set: what goes for certain, and the first of each class of buckets with several."""
    gone = np.array(table.column("gone").to_pylist(), bool)

    def read(name: str, kind: type, which: bool) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, g in zip(table.column(name).to_pylist(), gone, strict=True) if g == which), kind)

    doc, first, left, span = (read(n, k, False).astype(np.int64) for n, k in (("doc", np.int64), ("first", np.int64), ("left", np.uint8), ("span", np.uint8)))
    anchor, context = read("anchor", np.uint64, False), read("context", np.uint64, False)
    order, lead = settled((context, anchor), doc, first)
    there, here = order[lead], order[~lead]
    # leads come sorted by anchor and context: count the classes of each anchor
    a, c = anchor[there], context[there]
    fresh = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    kind = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else fresh
    bucket = np.cumsum(fresh) - 1
    classes = np.bincount(bucket[kind], minlength=int(fresh.sum()))[bucket] if len(a) else np.zeros(0, np.int64)
    open_ = there[classes > 1]
    out = [
        _decided(True, *merged(doc[here], first[here], first[here] + span[here])),
        _decided(True, *(read(n, np.int64, True) for n in ("doc", "first", "left"))),
        _decided(False, doc[open_], first[open_], first[open_] + span[open_], left[open_], anchor[open_], classes[classes > 1] > MANY),
    ]
    return pa.concat_tables(out)


_CONTEXT = "gone boolean, key long, doc long, first long, last long, left int, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of what is asked for in each document; windows of buckets with many classes singly."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    singles: dict[int, tuple[int, int]] = {}
    for batch in batches:
        asked = batch.column(batch.schema.get_field_index("asked")).to_pylist()
        at = 0
        for docs, texts in text_slices(iter([batch]), "doc"):
            rows = []
            for doc, text in zip(docs, texts, strict=True):
                for x in asked[at]:
                    first, last = x["first"], x["last"]
                    if last + LENGTH > len(text):
                        continue
                    if not x["many"]:
                        rows.append((False, x["anchor"], doc, first, last, x["left"], text[first : last + LENGTH]))
                        continue
                    for k in range(first, last + 1):
                        window = text[k : k + LENGTH]
                        key = signed(xxhash.xxh3_64_intdigest(window))
                        before = singles.setdefault(key, (doc, k))
                        if before < (doc, k):
                            rows.append((True, key, doc, k, k, None, None))
                            continue
                        singles[key] = (doc, k)
                        rows.append((False, key, doc, k, k, x["left"] - (k - first), window))
                at += 1
            if len(singles) > 1 << 20:
                singles.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _dense(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Ranks of rows by several keys, equal for equal rows."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.uint64)
    ranks[order] = np.cumsum(step)
    return ranks


def sorted_block(rows: np.ndarray, left: np.ndarray, span: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block that have an equal which starts earlier: row and window number in the row.

    rows: (n, WIDTH) bytes with the anchors in column CENTRE and the first window's start in CENTRE - left.
    """
    n = len(rows)
    flat = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)])
    word = lambda c: np.ndarray(n, ">u8", flat, offset=c, strides=(WIDTH,)).astype(np.uint64)
    # ranks of the cover sample to depth 16, 32, 64: sample columns stay sample columns MODULUS on
    sample = [c for c in range(WIDTH - 16) if c % MODULUS in COVER]
    rank = {c: _dense((word(c), word(c + 8))) for c in sample}
    for depth in (16, 32):
        rank = {c: _dense((rank[c], rank[c + depth])) for c in rank if c + depth in rank}
    found_row, found_window = [], []
    for start in range(CENTRE - ANCHORS + 1, CENTRE + 1):
        some = np.flatnonzero((start >= CENTRE - left) & (start <= CENTRE - left + span))
        if len(some) < 2:
            continue
        near = start + cover_shift(start % MODULUS, start % MODULUS)
        far = max(c for c in range(start, start + LENGTH - 64 + 1) if c % MODULUS in COVER)
        keys = (word(start), word(start + 8), rank[near], rank[far], word(start + LENGTH - 16), word(start + LENGTH - 8))
        order, lead = settled(tuple(k[some] for k in keys), doc[some], first[some] + start - (CENTRE - left[some]))
        late = some[order[~lead]]
        found_row.append(late)
        found_window.append(start - (CENTRE - left[late]))
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_window)


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; blocks end between keys."""
    held: list[tuple] = []
    gone: list[tuple] = []

    def block() -> pa.RecordBatch:
        d, f, l = (np.array([r[k] for r in gone], np.int64) for k in (2, 3, 4))
        if len(held) > 1:
            rows = np.zeros((len(held), WIDTH), np.uint8)
            for row, (_, _, _, _, _, left, data) in zip(rows, held, strict=True):
                row[CENTRE - left : CENTRE - left + len(data)] = np.frombuffer(data, np.uint8)
            doc, first, last, left = (np.array([r[k] for r in held], np.int64) for k in (2, 3, 4, 5))
            row, window = sorted_block(rows, left, last - first, doc, first)
            d, f, l = np.concatenate([d, doc[row]]), np.concatenate([f, first[row] + window]), np.concatenate([l, first[row] + window])
        held.clear()
        gone.clear()
        d, f, l = merged(d, f, l)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(f), pa.array(l)], ["doc", "first", "last"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0]:
                gone.append(row)
                continue
            if len(held) >= BLOCK_ROWS and row[1] != held[-1][1]:
                yield block()
            held.append(row)
    if held or gone:
        yield block()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(batch.schema.get_field_index("gone")).to_pylist()
        at = 0
        for docs, texts in text_slices(iter([batch]), "doc"):
            rows = []
            for doc, text in zip(docs, texts, strict=True):
                kept, end, removed, spans = hashlib.sha256(), 0, 0, 0
                for x in sorted((x["first"], x["last"] + LENGTH) for x in gone[at] or []):
                    a, b = max(x[0], end), min(x[1], len(text))
                    if b <= a:
                        continue
                    spans += a > end or not removed
                    kept.update(text[end:a])
                    removed, end = removed + b - a, b
                kept.update(text[end:])
                rows.append((None if doc == LAST_ID else doc, len(text), removed, spans, kept.hexdigest()))
                at += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _removed_runs(docs: DataFrame) -> DataFrame:
    """Runs (doc, first, last) of window starts that have an equal which starts earlier."""
    buckets = max(shuffle_partitions(docs.sparkSession), docs.rdd.getNumPartitions())
    sent = docs.select(F.col("doc").alias("doc_id"), "text").mapInArrow(_gather(buckets), _SENT)
    decided = written(sent.groupBy("bucket").applyInArrow(_classes, _DECIDED), "classes")
    asked = decided.filter("not gone").groupBy("doc").agg(F.collect_list(F.struct("first", "last", "left", "anchor", "many")).alias("asked"))
    contexts = docs.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_fetch, _CONTEXT)
    ordered = contexts.repartition(buckets, "key").sortWithinPartitions("key")
    late = written(ordered.mapInArrow(_sort_blocks, "doc long, first long, last long"), "equal-windows")
    return decided.filter("gone").select("doc", "first", "last").union(late)


def repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    gone = _removed_runs(keyed).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    return keyed.join(gone, "doc", "left").select("doc", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
