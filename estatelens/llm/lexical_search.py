"""Ranked lexical search over document-sharded CSR postings with precomputed integer impacts.

The index is a table of blocks. A block is a shard of some hundred documents (BLOCK_DOCS or BLOCK_BYTES, whichever comes
first) as compressed sparse rows: terms, where the postings of each term start, and for each posting the place of its
document in the block and its impact, the integer (1000000000 tf) div (1000 tf + 8 m). Impacts hold the corpus's
average length, so a first pass over the texts counts documents and terms; the second one writes the blocks.

Queries come in blocks too (QUERY_ITEMS items or QUERY_CHARS characters at a time), a stated set against all documents.
For a block of queries, document frequencies of its terms are summed from the index; then each task scores its
shards term at a time: the impacts of a term, times its weight, are added to a dense numpy accumulator, one
number a document. argpartition gives the k-th best score; all documents that reach it are taken, so ties
are settled by doc_id and never by chance. A task keeps k documents an item over all its shards; Spark merges them in two
rounds, first within groups of tasks.

Defined results: null and empty texts, and texts without a term, are in no result and count for nothing; items without
terms have no results; of equal scores the smaller doc_id comes first, null ids last; rows that repeat a doc_id or an
item_id are documents or items of their own; very long texts are one block; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import text_slices, written

#: Documents and bytes of text of a block; items and characters of a block of queries; groups of tasks that are merged first.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
QUERY_ITEMS, QUERY_CHARS, GROUPS = 1024, 4 << 20, 64
#: Fixed values of the score: impacts are in units of 1/SCALE, SLOPE percent of a document's length counts.
SCALE, SLOPE = 1_000_000_000, 90
_INDEX = "block_docs int, doc_ids array<long>, terms binary, starts binary, docs binary, impacts binary"


def _spaced() -> bytes:
    """A table for bytes.translate: separators become spaces, A to Z lower case, all else stays."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = b if c.isdigit() or c.islower() else b + 32 if c.isupper() else 32
    return bytes(table)


_SPACED = _spaced()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for _, texts in text_slices(batches):
        sizes = [len(terms_of(t)) for t in texts]
        documents, terms = documents + sum(map(bool, sizes)), terms + sum(sizes)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    counted = docs.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_count, "documents long, terms long")
    return tuple(counted.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def _block(ids: list, texts: list[list[bytes]], documents: int, terms: int) -> dict:
    """Compressed sparse rows of some documents, given as lists of terms, none of them empty."""
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(t, len(numbers)) for t in text], np.int64) for text in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    # a posting's key is its term, then its document; equal keys are one posting
    keys, tf = np.unique(np.concatenate([c * len(texts) + k for k, c in enumerate(coded)]), return_counts=True)
    term, doc = np.divmod(keys, len(texts))
    m = 100 - SLOPE + SLOPE * sizes[doc] * documents // terms
    impacts = SCALE * tf.astype(np.int64) // (1000 * tf + 8 * m)
    starts = np.searchsorted(term, np.arange(len(numbers) + 1))
    return {"block_docs": len(texts), "doc_ids": ids, "terms": b"\n".join(numbers), "starts": starts.astype("<i4").tobytes(), "docs": doc.astype("<i4").tobytes(), "impacts": impacts.astype("<i4").tobytes()}


_ARROW = pa.schema([("block_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary())])


def _blocks(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0

        for some, slices in text_slices(batches):
            for doc_id, text in zip(some, slices, strict=True):
                words = terms_of(text)
                if words:
                    ids.append(doc_id)
                    texts.append(words)
                    held += len(text)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts, documents, terms)], _ARROW)
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, texts, documents, terms)], _ARROW)

    return run


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The blocks, written, and the number of documents with a term."""
    documents, terms = corpus_size(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_blocks(documents, terms), _INDEX), "postings"), documents


def _wanted(row_terms: bytes, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's terms that are wanted, and which ones they are."""
    which = pc.index_in(pa.array(row_terms.split(b"\n"), pa.binary()), value_set=wanted)
    here = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
    return here, which.fill_null(-1).to_numpy()[here]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of these terms."""
    wanted = pa.array(terms, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _rows(batches):
            here, which = _wanted(row["terms"], wanted)
            total[which] += np.diff(np.frombuffer(row["starts"], "<i4"))[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    counted = index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {terms[r["term"]]: r["n"] for r in counted.collect()}  # as many rows as the block of queries has terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, best first, equal ones by ids; every score that ties with the k-th is looked at."""
    least = 1
    if len(scores) > k:
        least = max(least, scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]])
    near = np.flatnonzero(scores >= least)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


#: Stands for a missing doc_id while documents are compared: after all others.
_NO_ID = np.iinfo(np.int64).max


def _search(items: list[list[bytes]], weights: dict[bytes, int], k: int):
    """items: the distinct terms of each query. Gives (item, doc_id, score) of the k best of a task."""
    terms = sorted(weights)
    wanted, place = pa.array(terms, pa.binary()), {t: n for n, t in enumerate(terms)}
    queries = [np.array([place[t] for t in item if t in place], np.int64) for item in items]
    worth = np.array([weights[t] for t in terms], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for row in _rows(batches):
            here, which = _wanted(row["terms"], wanted)
            starts, docs, impacts = (np.frombuffer(row[c], "<i4") for c in ("starts", "docs", "impacts"))
            ids = np.array([_NO_ID if i is None else i for i in row["doc_ids"]], np.int64)
            lists: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(terms)
            for at, n in zip(here.tolist(), which.tolist(), strict=True):
                a, b = starts[at], starts[at + 1]
                lists[n] = docs[a:b], impacts[a:b].astype(np.int64) * worth[n]
            for n, query in enumerate(queries):
                scores = np.zeros(row["block_docs"], np.int64)
                for t in query.tolist():
                    if lists[t] is not None:
                        scores[lists[t][0]] += lists[t][1]
                got = best(scores, ids, k)
                if len(got):
                    both = np.concatenate((top[n][0], scores[got])), np.concatenate((top[n][1], ids[got]))
                    order = np.lexsort((both[1], -both[0]))[:k]
                    top[n] = both[0][order], both[1][order]
        sizes = [len(s) for s, _ in top]
        ids = np.concatenate([i for _, i in top]) if top else np.zeros(0, np.int64)
        columns = [pa.array(np.repeat(np.arange(len(top)), sizes)), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([s for s, _ in top]) if top else ids)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(ids), TaskContext.get().partitionId() % GROUPS))], ["item", "doc_id", "score", "part"])

    return run


def _query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of a bounded size; the driver holds one block and the partition that it comes from."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        held += len(row["text"] or "")
        if len(block) >= QUERY_ITEMS or held >= QUERY_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10) -> DataFrame:
    """Per item of items (item_id, text): its k documents of the highest scores above 0, as item_id, rank, doc_id, score."""
    spark, outs = index.sparkSession, []
    id_type = items.schema["item_id"].dataType.simpleString()
    for block in _query_blocks(items):
        asked = [sorted(set(terms_of((text or "").encode()))) for _, text in block]
        weights = {t: weight(documents, df) for t, df in document_frequencies(index, sorted(set().union(*asked))).items()}
        found = index.mapInArrow(_search(asked, weights, k), "item long, doc_id long, score long, part long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for by in (["item", "part"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(block)], f"item long, item_id {id_type}")
        outs.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, outs) if outs else spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of docs for each of items: item_id, rank (from 1), doc_id, score."""
    index, documents = build_index(docs)
    return search(index, documents, items, k)
