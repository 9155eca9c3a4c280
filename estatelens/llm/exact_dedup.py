"""Exact dedup: radix-trie owners over length-and-content-hash partitions.

Map side, each task inserts its normalised texts (all white space out) into a compressed radix trie whose
terminal nodes hold the best owner and a count; a trie over its memory bound spills its largest subtrees
downstream. So a group of copies that is a third of the corpus leaves a task as one row. Rows then go to
partitions of (length, SHA-256); there they arrive sorted by that key, and each run of a key is a trie of
its own that is emitted and freed when the run ends. Full byte strings are compared, never only hashes.

Defined results: null text counts as empty, all empty texts are one group; of equal texts the row with the
most code points in the original text stays, then the smallest doc_id, null ids last; rows that repeat a
doc_id carry the same answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import join_groups, shuffle_partitions, text_slices, written

#: Deleted before texts are compared: [\x20\x09-\x0D].
WHITE = b" \t\n\v\f\r"
#: Bytes that one map-side trie may hold before subtrees are spilled: labels, and NODE_BYTES for each node and its owner.
TRIE_BYTES, NODE_BYTES = 96 << 20, 400


class Owner:
    """What a terminal node holds: the row that stays so far, and how many rows ended here."""

    __slots__ = ("chars", "count", "doc_id")

    def __init__(self, chars: int, doc_id: int | None, count: int) -> None:
        self.chars, self.doc_id, self.count = chars, doc_id, count

    def merge(self, chars: int, doc_id: int | None, count: int) -> None:
        self.count += count
        nulls_last = (self.doc_id is None, self.doc_id or 0)
        if (-chars, doc_id is None, doc_id or 0) < (-self.chars, *nulls_last):
            self.chars, self.doc_id = chars, doc_id


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None) -> None:
        self.label, self.owner, self.children = label, owner, {}


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving the doubtful stretch so that the comparing is done in C."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed (Patricia) trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, chars: int, doc_id: int | None, count: int = 1) -> None:
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = Node(rest, Owner(chars, doc_id, count))
                self.bytes += len(rest) + NODE_BYTES
                return
            n = len(child.label) if rest.startswith(child.label) else _common(child.label, rest)
            if n < len(child.label):
                upper = Node(child.label[:n])
                self.bytes += NODE_BYTES
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[rest[0]] = child = upper
            node, rest = child, rest[n:]
        if node.owner is None:
            node.owner = Owner(chars, doc_id, count)
        else:
            node.owner.merge(chars, doc_id, count)

    def drain(self, node: Node | None = None) -> Iterator[tuple[bytes, Owner]]:
        """All keys below a node (of the root if none) with their owners."""
        todo = [(node or self.root, b"")]
        while todo:
            at, before = todo.pop()
            path = before + at.label
            if at.owner is not None:
                yield path, at.owner
            todo += [(child, path) for child in at.children.values()]

    def spill(self, limit: int) -> Iterator[tuple[bytes, Owner]]:
        """Take out the largest subtrees of the root until at most limit bytes are held."""
        sizes = []
        for first, child in self.root.children.items():
            total, todo = 0, [child]
            while todo:
                at = todo.pop()
                total += len(at.label) + NODE_BYTES
                todo += at.children.values()
            sizes.append((total, first))
        for total, first in sorted(sizes, reverse=True):
            if self.bytes <= limit:
                return
            yield from self.drain(self.root.children.pop(first))
            self.bytes -= total


_PARTIAL = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("body", pa.binary()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])


def _partial_rows(found: Iterator[tuple[bytes, Owner]]) -> Iterator[pa.RecordBatch]:
    """Batches of about 4 MB of what a trie gives up."""
    rows: list[tuple] = []
    held = 0
    for body, owner in found:
        rows.append((len(body), hashlib.sha256(body).hexdigest(), body, owner.chars, owner.doc_id, owner.count))
        held += len(body)
        if held > 4 << 20 or len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = RadixTrie()
    for ids, texts in text_slices(batches):
        for doc_id, text in zip(ids, texts, strict=True):
            chars = len(text) if text.isascii() else len(text.decode())
            trie.insert(text.translate(None, WHITE), chars, doc_id)
        if trie.bytes > TRIE_BYTES:
            yield from _partial_rows(trie.spill(TRIE_BYTES // 2))
    yield from _partial_rows(trie.drain())


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (length, hash): one trie a key, emitted when the key ends."""
    key, trie, out = None, RadixTrie(), []

    def ended() -> None:
        found = list(trie.drain())
        if len(found) > 1:
            raise ValueError(f"texts of one length and one SHA-256 differ: {key}")
        out.extend((*key, owner.doc_id, owner.count) for _, owner in found)

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OWNERS, strict=True)], schema=_OWNERS)
        out.clear()
        return rows

    for b in batches:
        sizes, shas, chars, ids, counts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n_bytes", "text_sha256", "chars", "doc_id", "n"))
        bodies = b.column(b.schema.get_field_index("body"))
        for i in range(b.num_rows):
            if (sizes[i], shas[i]) != key:
                if key is not None:
                    ended()
                key, trie = (sizes[i], shas[i]), RadixTrie()
            trie.insert(bodies[i].as_py(), chars[i], ids[i], counts[i])
        if len(out) > 4096:
            yield batch()
    if key is not None:
        ended()
    if out:
        yield batch()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches):
        bodies = [t.translate(None, WHITE) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], schema=_DIGESTS)


def owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: n_bytes, text_sha256, keep_id, group_size."""
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_combine, "n_bytes long, text_sha256 string, body binary, chars long, doc_id long, n long")
    dealt = partial.repartition(shuffle_partitions(docs.sparkSession), "n_bytes", "text_sha256").sortWithinPartitions("n_bytes", "text_sha256")
    return dealt.mapInArrow(_own, "n_bytes long, text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest, "doc_id long, n_bytes long, text_sha256 string")
    groups = written(owners(docs), "owners")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    found = join_groups(digests, groups, ["n_bytes", "text_sha256"], "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _number(sha: Column) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each text.

    A keeper is found by doc_id and text. Of rows that repeat both, one with the most code points stays; only such rows are shuffled whole.
    """
    bare = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")
    marked = docs.withColumn("_text", _number(F.sha2(bare, 256)))
    keep = owners(docs).select(F.col("keep_id").alias("_keep_id"), _number(F.col("text_sha256")).alias("_keep_text"))
    stay = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text") == F.col("_keep_text")), "left_semi")
    twice = marked.groupBy("doc_id", "_text").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_twice_id"), F.col("_text").alias("_twice_text"))
    repeated = F.col("doc_id").eqNullSafe(F.col("_twice_id")) & (F.col("_text") == F.col("_twice_text"))
    once, again = stay.join(twice, repeated, "left_anti"), stay.join(twice, repeated, "left_semi")
    longest = again.groupBy("doc_id", "_text").agg(F.max_by(F.struct(*[F.col(c) for c in docs.columns]), F.length("text")).alias("_row"))
    return once.drop("_text").union(longest.select("_row.*"))
