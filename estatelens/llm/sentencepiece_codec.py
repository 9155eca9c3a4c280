"""SentencePiece encoding and decoding by a table of distinct chunks.

In this model no piece holds a white-space marker after another character, so pieces cannot cross from
text into a marker. A normalised text therefore falls apart, wherever a marker follows something else, into
chunks (a run of markers and what follows) that are segmented on their own. Each task keeps a table of
the distinct chunks it has met: a chunk is segmented once by the library, and a text's ids are its chunks'
ids joined by position. The table is emptied when it reaches a bound on its bytes, which costs repeated
work and changes no result. The precondition is checked against the vocabulary when a task starts; a model
that fails it, or that changes characters before segmenting, is run by the library on whole texts.

Decoding gives ids back to the library.

Defined results: null text counts as empty; an empty text has no ids; an id that no piece has fails the
task, as in the library; rows that repeat get the same answer; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import text_slices

MARK = "▁"
#: Characters of chunks that a task's table may hold.
TABLE_CHARS = 16 << 20
#: A chunk is segmented by the table only up to this many characters; longer ones go to the library each time.
LONG_CHUNK = 256


class ChunkCodec:
    """Encodes and decodes with one SentencePiece model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.raw = self._bare_model(model) if self.apart else None
        self.table: dict[str, list[int]] = {}
        self.held = 0

    def _plain(self) -> bool:
        """Whether the model takes text as it is: spaces to markers, one marker in front, nothing else."""
        probes = ["a b", "  a  b ", "ﬁ ①", "é x", "\ta\r\nb", f"a{MARK}b", "Ａ　b"]
        return all(self.library.normalize(x) == MARK + x.replace(" ", MARK) for x in probes)

    @staticmethod
    def _bare_model(model: str):
        """The same model without the marker in front, for chunks that have their own."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if not self.apart:
            return self.library.encode(texts, num_threads=1)
        parts = [CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > TABLE_CHARS:
            self.table, self.held = {}, 0
        table = self.table
        new = list({c for p in parts for c in p if c not in table})
        for chunk, ids in zip(new, self.raw.encode(new, num_threads=1), strict=True):
            table[chunk] = ids
            self.held += len(chunk) + 8 * len(ids)
        out = [list(chain.from_iterable(map(table.__getitem__, p))) for p in parts]
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                self.held -= len(chunk) + 8 * len(table.pop(chunk))
        return out

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def _coded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for doc_ids, texts in text_slices(batches):
            ids = codec.encode_all([t.decode() for t in texts])
            decoded = codec.decode_all(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for doc_ids, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(codec.encode_all([t.decode() for t in texts]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode_all(ids) if ids else [], pa.string())], ["doc_id", "text"])

    return run


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    return _needed(docs).mapInArrow(_ids(model), "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give an empty text."""
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(model), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass."""
    return _needed(docs).mapInArrow(_coded(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
