"""Best-fit packing by bin completion over a histogram of piece lengths.

Texts become pieces of at most CAPACITY tokens in one pass, which is written. Pieces of one length are
interchangeable, so packing works on how many pieces each length has: CAPACITY counts at most, for any
corpus. The search is branch and bound by bin completion: the bin of the largest piece left is completed
by each undominated filling, best first, as many times over as the counts allow; a branch is pruned once
its waste rules out fewer bins than the incumbent. Incumbents are best-fit-decreasing solutions, at the root
and below each branch, and at the root a dive that completes each bin by subset sums. The search ends when the incumbent meets the lower bound, which proves it optimal,
or after NODES branches; then the incumbent stands. The limits are parameters of bin_completion(); with Limits.exact()
every undominated filling is enumerated and every branch opened, which is for small histograms only.

A piece finds its place from its rank among the pieces of its length. Ranks are counts within each task plus
offsets by task and length, so no key is gathered or sorted in one place.

Defined results: null text counts as empty; an empty text is one piece of one token; rows that repeat are
packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import text_slices, written

CAPACITY = 2048
#: Ends each document.
END_ID = 0


@dataclass(frozen=True)
class Limits:
    """Branches that the search may open, fillings kept of one bin, and pieces chosen freely in a filling beside the largest."""

    nodes: float = 200
    fillings: float = 6
    members: float = 3

    @staticmethod
    def exact() -> "Limits":
        return Limits(float("inf"), float("inf"), float("inf"))



#: (lengths in falling order) -> how many bins are filled so.
Packing = dict[tuple[int, ...], int]


def lower_bound(counts: Counter, capacity: int) -> int:
    """The larger of the total over the capacity and the bins that large pieces need (Martello and Toth's L2)."""
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for small in [0, *[s for s in sizes if s <= capacity // 2]]:
        big = sum(n for s, n in counts.items() if s > capacity - small)
        middle = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - small]
        free = sum((capacity - s) * n for s, n in middle)
        rest = sum(s * n for s, n in counts.items() if small <= s <= capacity // 2)
        best = max(best, big + sum(n for _, n in middle) + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(counts: Counter, capacity: int) -> Packing:
    """Best fit decreasing, on counts: groups of equal bins are filled together."""
    free: dict[int, Counter] = {}  # room -> filling -> bins
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        for room in sorted(r for r in free if r >= size):
            each, fillings = room // size, free[room]
            while left and fillings:
                filling, bins = fillings.popitem()
                full = min(bins, left // each)
                some = left % each if full < bins and left // each == full else 0
                for take, n in ((each, full), (some, 1 if some else 0)):
                    if n:
                        free.setdefault(room - take * size, Counter())[filling + (size,) * take] += n
                        left -= take * n
                        bins -= n
                if bins:
                    fillings[filling] += bins
                    break
            if not fillings:
                free.pop(room, None)
            if not left:
                break
        each = capacity // size
        for take, n in ((each, left // each), (left % each, 1)):
            if take and n:
                free.setdefault(capacity - take * size, Counter())[(size,) * take] += n
    out: Counter = Counter()
    for fillings in free.values():
        out.update(fillings)
    return dict(out)


def least_waste(counts: Counter, room: int) -> tuple[int, ...]:
    """The pieces with the largest sum within the room, by subset sums; plentiful lengths are used first."""
    sums, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for size in sorted((s for s, n in counts.items() if n and s <= room), key=lambda s: (-s * counts[s], s)):
        left, step = min(counts[size], room // size), 1
        while left:
            take = min(step, left)
            before, sums = sums, (sums | sums << (size * take)) & mask
            if sums != before:
                layers.append((size, take, before))
            left, step = left - take, step * 2
        if sums >> room & 1:
            break
    target, used = sums.bit_length() - 1, []
    for size, take, before in reversed(layers):
        if not before >> target & 1:
            used += [size] * take
            target -= size * take
    return tuple(sorted(used, reverse=True))


def complete(counts: Counter, capacity: int) -> Packing:
    """A packing by completing the bin of the largest piece left with the least waste, again and again."""
    left, out = +Counter(counts), Counter()
    while left:
        largest = max(left)
        left[largest] -= 1
        bin_ = (largest, *least_waste(left, capacity - largest))
        left[largest] += 1
        need = Counter(bin_)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out[tuple(sorted(bin_, reverse=True))] += times
    return dict(out)


def dominates(better: tuple[int, ...], worse: tuple[int, ...]) -> bool:
    """Whether the pieces of worse fit, in groups, into the pieces of better as into bins."""

    def place(todo: tuple[int, ...], rooms: tuple[int, ...]) -> bool:
        if not todo:
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= todo[0] and room not in tried:
                tried.add(room)
                if place(todo[1:], (*rooms[:k], room - todo[0], *rooms[k + 1 :])):
                    return True
        return False

    return place(worse, better)


def fillings(counts: Counter, largest: int, room: int, limits: Limits = Limits()) -> list[tuple[int, ...]]:
    """Undominated fillings of the room beside the largest piece, least waste first.

    Fillings of up to limits.members pieces are found by choosing all but the last piece among the largest that
    fit and the last as the best fit for what is left; the best-fit filling of any number is added.
    """
    sizes = sorted((s for s, n in counts.items() if n > (s == largest) and s <= room), reverse=True)
    found: set[tuple[int, ...]] = set()

    def fitting(left: int, used: tuple[int, ...]) -> int | None:
        return next((s for s in sizes if s <= left and counts[s] - (s == largest) > used.count(s)), None)

    def extend(used: tuple[int, ...], left: int) -> None:
        last = fitting(left, used)
        if last is None:
            found.add(used)
            return
        if len(used) + 1 >= limits.members:
            while (last := fitting(left, used)) is not None:
                used, left = (*used, last), left - last
            found.add(used)
            return
        choices = [s for s in sizes if s <= left and s <= (used[-1] if used else s)]
        for s in choices[: int(min(2 * limits.fillings, len(choices)))]:
            if counts[s] - (s == largest) > used.count(s):
                extend((*used, s), left - s)

    extend((), room)
    kept: list[tuple[int, ...]] = []
    for f in sorted((tuple(sorted(f, reverse=True)) for f in found), key=lambda f: (room - sum(f), len(f), tuple(-s for s in f))):
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == limits.fillings:
            break
    return kept


def bin_completion(counts: Counter, capacity: int, limits: Limits = Limits()) -> Packing:
    """A packing in as few bins as the search finds."""
    total = sum(size * n for size, n in counts.items())
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    if sum(incumbent.values()) > bound:
        incumbent = min(incumbent, complete(counts, capacity), key=lambda p: sum(p.values()))
    best = sum(incumbent.values())
    todo: list[tuple[Counter, dict, int, int]] = [(Counter(counts), {}, 0, 0)]
    nodes = 0
    while todo and best > bound and nodes < limits.nodes:
        left, done, bins, waste = todo.pop()
        nodes += 1
        if waste > (best - 1) * capacity - total:
            continue
        largest = max((s for s, n in left.items() if n), default=0)
        if not largest:
            incumbent, best = done, bins
            continue
        branches = []
        for filling in fillings(left, largest, capacity - largest, limits):
            bin_ = (largest, *filling)
            need = Counter(bin_)
            # an exact search fills one bin at a time, as two equal bins need not be best
            times = 1 if limits == Limits.exact() else min(left[s] // n for s, n in need.items())
            now = Counter(left)
            for s, n in need.items():
                now[s] -= n * times
            key = tuple(sorted(bin_, reverse=True))
            branch = (+now, done | {key: done.get(key, 0) + times}, bins + times, waste + times * (capacity - sum(bin_)))
            rest = best_fit(branch[0], capacity)
            if branch[2] + sum(rest.values()) < best:
                best = branch[2] + sum(rest.values())
                incumbent = dict(Counter(branch[1]) + Counter(rest))
            branches.append(branch)
        todo += reversed(branches)
    return incumbent


@dataclass
class Places:
    """Where the pieces of each length go, as runs of ranks; sorted by (length, first rank)."""

    key: np.ndarray  # length << 40 | first rank
    each: np.ndarray  # pieces of the run in one bin
    sequence: np.ndarray  # first bin
    offset: np.ndarray  # of the run's first piece in its bin

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 40 | rank, side="right") - 1
        step = rank - (self.key[at] & (1 << 40) - 1)
        return self.sequence[at] + step // self.each[at], self.offset[at] + step % self.each[at] * length


def placed(packing: Packing) -> Places:
    """Runs: at most the kinds of lengths of each filling, whatever the number of pieces."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for filling in sorted(packing, reverse=True):
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            rows.append((size << 40 | ranks[size], n, sequence, offset))
            ranks[size] += n * packing[filling]
            offset += n * size
        sequence += packing[filling]
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*(table[:, k].copy() for k in range(4)))


_ENCODERS: dict[str, object] = {}
_LIBRARY: dict[str, object] = {}
#: White space that tiktoken's expressions may not take in one piece; such texts go to the tokenizers library.
_LONG_BLANK = re.compile(r"\s{100000}")


def encoder(tokenizer: str):
    """ids of a text as uint32, equal to those of the tokenizers library with this byte-level BPE file.

    The file's vocabulary is run by tiktoken, which gives the same ids several times as fast; the file's added
    tokens are recognised inside texts, as the library does.
    """
    if tokenizer not in _ENCODERS:
        import json

        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            file = json.load(f)
        model, special = file["model"], {x["content"]: x["id"] for x in file["added_tokens"]}
        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(stand_in[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODERS[tokenizer] = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    coder = _ENCODERS[tokenizer]

    def encode(text: str) -> np.ndarray:
        if _LONG_BLANK.search(text):
            if tokenizer not in _LIBRARY:
                from tokenizers import Tokenizer

                _LIBRARY[tokenizer] = Tokenizer.from_file(tokenizer)
            return np.array(_LIBRARY[tokenizer].encode(text, add_special_tokens=False).ids, np.uint32)
        return coder.encode_to_numpy(text, allowed_special="all")

    return encode


def cut(size: int, capacity: int) -> list[int]:
    """Edges of the pieces of a document; the first piece may be shorter than the capacity."""
    if size <= capacity:
        return [0, size]
    return [0, *range(size % capacity or capacity, size + 1, capacity)]


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for ids, texts in text_slices(batches):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text.decode()), END_ID).astype("<u4")
                edges = cut(len(tokens), capacity)
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            number = lambda n: column[n].to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            sequence, offset = places.find(number("length"), number("nth") + number("before"))
            yield pa.RecordBatch.from_arrays([column["doc_id"], column["piece"], column["start"], column["length"], column["ids_crc32"], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, limits: Limits = Limits()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. limits bound the search, never the pieces."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(ids.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(per_task.withColumn("before", before), "offsets")
    histogram = offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    places = placed(bin_completion(Counter({r["length"]: r["n"] for r in histogram}), capacity, limits))
    # offsets grow with the tasks, so they are merged and never sent whole to each executor
    ranked = pieces.join(offsets.select("part", "length", "before").hint("merge"), ["part", "length"])
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(_place(places), out)
