"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words with one space between. Rules are regular expressions
over that word stream. One Aho-Corasick pass over the text finds the rules' keywords; only rules whose
keyword occurs are run. Of overlapping detections, one that lies inside another is suppressed by it if the
other has a higher priority, or the same and more words, or comes first in the rule order.

Rules are hand-written expressions (license_rules.py: sentences and clauses of license texts, notices, identifiers,
short names), and, for licenses with many names and versions, statement forms ("licensed under ...") around each name.

Defined results: null text counts as empty; without words all counts are 0, first_word and last_word are
null, labels are empty and the score is 0; rows that repeat get the same answer; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import text_slices
from estatelens.llm.license_rules import CLAUSES, NOTICES, SHORT, SPDX, TEXTS

#: Phrases whose every place counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, names as they read in the word stream, versions (as words; "" if none is needed).
FAMILIES = (
    ("apache", ("apache license", "apache software license", "apache"), ("1 0", "1 1", "2 0", "2")),
    ("mit", ("mit license", "mit licence", "expat license", "x11 license", "mit x11 license"), ("",)),
    ("bsd", ("bsd license", "bsd licence", "new bsd license", "modified bsd license", "simplified bsd license", "freebsd license"), ("",)),
    ("bsd-2-clause", ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "two clause bsd license"), ("",)),
    ("bsd-3-clause", ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "three clause bsd license"), ("",)),
    ("isc", ("isc license", "isc licence"), ("",)),
    ("agpl", ("gnu affero general public license", "affero general public license", "agpl"), ("3 0", "3", "1 0")),
    ("lgpl", ("gnu lesser general public license", "lesser general public license", "gnu library general public license", "lgpl"), ("2 0", "2 1", "3 0", "3")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1 0", "2 0", "2", "3 0", "3")),
    ("gfdl", ("gnu free documentation license", "free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public license",), ("1 0",)),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    ("afl", ("academic free license",), ("2 1", "3 0")),
    ("osl", ("open software license",), ("2 1", "3 0")),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("boost", ("boost software license",), ("1 0",)),
    ("zlib", ("zlib license", "zlib libpng license", "libpng license"), ("",)),
    ("unlicense", ("unlicense", "the unlicense"), ("",)),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("2", "")),
    ("psf", ("python software foundation license", "psf license", "python license"), ("2", "")),
    ("php", ("php license",), ("3 0", "3 01")),
    ("ruby", ("ruby license",), ("",)),
    ("postgresql", ("postgresql license",), ("",)),
    ("openssl", ("openssl license",), ("",)),
    ("ms-pl", ("microsoft public license", "ms pl"), ("",)),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), ("",)),
    ("odbl", ("open database license", "odbl"), ("1 0", "")),
    ("odc-by", ("open data commons attribution license", "odc by"), ("1 0", "")),
    ("bsl", ("business source license", "busl"), ("1 1",)),
    ("sspl", ("server side public license", "sspl"), ("1",)),
    ("elastic", ("elastic license",), ("2 0", "")),
    ("cc0", ("creative commons zero", "cc0", "cc zero"), ("1 0", "")),
    ("public-domain", ("public domain dedication",), ("",)),
)
#: Creative Commons elements, short and long, and versions.
CC_ELEMENTS = (
    ("by", "attribution"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc", "attribution non ?commercial"),
    ("by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by sa", "attribution share ?alike"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Forms of a statement around a name, their priority and weight.
FORMS = (
    ("spdx license identifier {name}", 4, 0.98),
    ("(?:licensed|released|distributed|available|provided|published|made available|redistributed) under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?(?:\\S+ )?{name}", 3, 0.95),
    ("(?:subject to|governed by|covered by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 3, 0.9),
    ("{name}", 2, 0.6),
)


@dataclass(frozen=True)
class Rule:
    """order: place in the rule list; keyword: words that any match holds."""

    order: int
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: re.Pattern


@dataclass(frozen=True)
class Detection:
    label: str
    rule: int
    priority: int
    weight: float
    first: int
    end: int  # word after the last


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order."""
    out: list[Rule] = []

    def add(label: str, priority: int, weight: float, keyword: str, expression: str) -> None:
        out.append(Rule(len(out), label, priority, weight, keyword, re.compile(f"(?<= )(?:{expression})(?= )")))

    for label, keyword, expression in TEXTS + CLAUSES:
        add(label, 5, 0.97, keyword, expression)
    for label, keyword, expression in NOTICES:
        add(label, 4, 0.8, keyword, expression)
    for name in SPDX:
        add(re.sub(r"(?<=[0-9]) (?=[0-9])", ".", name).replace(" ", "-"), 6, 0.99, f"spdx license identifier {name}", f"spdx license identifier {name}")
    for name in SHORT:
        add(name, 3, 0.9, name, rf"(?:licensed|released|distributed|available) under (?:the )?{name}(?: license)?|licen[sc]es? (?:is )?{name}")
    for short, long in CC_ELEMENTS:
        label = "cc-" + short.replace(" ", "-")
        for keyword, name in ((f"cc {short}", f"cc {short}"), ("creative commons", f"creative commons {long}(?: license)?")):
            for form, priority, weight in FORMS:
                for version in CC_VERSIONS:
                    add(f"{label}-{version.replace(' ', '.')}", priority + 1, weight, keyword, form.format(name=f"{name}(?: version)? {version}(?: international| unported)?"))
                add(label, priority, weight, keyword, form.format(name=name))
    for label, names, versions in FAMILIES:
        for name in names:
            bare = " " not in name or name == "python license"
            for form, priority, weight in FORMS:
                for version in versions:
                    if version:
                        add(f"{label}-{version.replace(' ', '.')}", priority + 1, weight, name, form.format(name=f"{name}(?: license)?(?: version| v)? v?{version}(?: or(?: \\S+)? later)?"))
                if not bare or form != "{name}":
                    add(label, priority, weight, name, form.format(name=name))
    return tuple(out)


class Scanner:
    """The compiled rule set of one task."""

    def __init__(self) -> None:
        import ahocorasick

        self.by_keyword: dict[str, list[Rule]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        self.keywords = ahocorasick.Automaton()
        for keyword in self.by_keyword:
            self.keywords.add_word(f" {keyword} ", keyword)
        self.keywords.make_automaton()

    def detections(self, stream: str) -> list[Detection]:
        """stream: the words with a space before each and one at the end."""
        hit = {keyword for _, keyword in self.keywords.iter(stream)}
        if not hit:
            return []
        found = []
        for rule in sorted((r for k in hit for r in self.by_keyword[k]), key=lambda r: r.order):
            at, words = 0, 0
            for m in rule.pattern.finditer(stream):
                words += stream.count(" ", at, m.start())
                at = m.start()
                found.append(Detection(rule.label, rule.order, rule.priority, rule.weight, words - 1, words + m[0].count(" ")))
        return suppressed(found)


def suppressed(found: list[Detection]) -> list[Detection]:
    """What stays when a detection inside a stronger one goes, by first word; O(n log n).

    Whatever lies inside a suppressed detection lies inside its suppressor too, so it is enough to hold
    each detection against those that stay: strongest first, a detection goes if one that starts no later
    ends no earlier. Those that stay are kept as an ever-growing frontier of ends by start.
    """
    from bisect import bisect_right, insort

    starts: list[int] = []
    ends: dict[int, int] = {}
    out = []
    for d in sorted(found, key=lambda d: (-d.priority, d.first - d.end, d.rule, d.first)):
        k = bisect_right(starts, d.first)
        if k and ends[starts[k - 1]] >= d.end:
            continue
        out.append(d)
        # starts whose reach the new one covers leave the frontier
        k = bisect_right(starts, d.first)
        while k < len(starts) and ends[starts[k]] <= d.end:
            del ends[starts.pop(k)]
        if d.first in ends:
            ends[d.first] = d.end
        else:
            insort(starts, d.first)
            ends[d.first] = d.end
    return sorted(out, key=lambda d: (d.first, d.rule))


#: By byte: A-Z to lower case, what parts words to a space; bytes of non-ASCII characters are parts of words.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_stream(text: bytes) -> bytes:
    """The words of a text, a space before each and one at the end."""
    return b" " + b" ".join([*text.translate(_TO_WORDS).split(), b""])


def base_places(stream: bytes) -> list[tuple[int, str]]:
    """(word, label) of all places of the base phrases."""
    out = []
    for phrase, label in BASE:
        needle, at, words, before = f" {phrase} ".encode(), stream.find(f" {phrase} ".encode()), 0, 0
        while at >= 0:
            words += stream.count(b" ", before, at)
            before = at
            out.append((words, label))
            at = stream.find(needle, at + 1)
    return out


def score(detections: list[Detection], n_base: int) -> float:
    """0 to 1: the odds that at least one statement is meant as a license, each independent of the others."""
    miss = 0.5 if n_base else 1.0
    for weight in {d.label: d.weight for d in sorted(detections, key=lambda d: d.weight)}.values():
        miss *= 1 - weight
    return round(1 - miss, 6)


_REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for ids, texts in text_slices(batches):
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            stream = word_stream(text)
            places, found = base_places(stream), scanner.detections(stream.decode())
            words, base = [w for w, _ in places], sorted({label for _, label in places})
            labels = sorted({*base, *(d.label for d in found)})
            rows.append((doc_id, stream.count(b" ") - 1, len(places), min(words, default=None), max(words, default=None), ",".join(base), ",".join(labels), score(found, len(places))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = [x.split()[0] for x in _REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
    for ids, texts in text_slices(batches):
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            stream = word_stream(text).decode()
            found = scanner.detections(stream)
            words = stream.split() if found else []
            rows += [(doc_id, d.label, d.rule, d.priority, d.weight, d.first, d.end, " ".join(words[d.first : d.end])) for d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "label", "rule", "priority", "weight", "first_word", "end_word", "words"])


def license_detections(docs: DataFrame) -> DataFrame:
    """One row per detection that stays: doc_id, label, rule, priority, weight, first_word, end_word, words."""
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return needed.mapInArrow(_found, "doc_id long, label string, rule int, priority int, weight double, first_word long, end_word long, words string")


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report, _REPORT)
