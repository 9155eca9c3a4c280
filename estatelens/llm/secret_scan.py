"""Secret scans: candidate rules, then a random forest that removes false positives.

Rules with a cheap gate (words that any match holds) propose candidates; of overlapping candidates the
earlier rule's stays. No rule bounds the length of a secret from above, so none is cut. Each candidate becomes
features of its length, its characters and their transitions, how much of it dictionary words cover, its path and
the words around it. A random forest, grown here from labelled findings, gives the odds of a real secret; candidates
below THRESHOLD are marked as not kept.

The dictionary is the lower-case whole words of a tokenizer's vocabulary file, whose path is a parameter, and a short
list of words of configuration files; without a file it is that list alone. Letter transitions come from it too.

The labelled findings are a bounded table: LABELLED rows of a stated generator by default (secrets of many
formats in the places where they occur, against hashes, identifiers, placeholders, template variables and
plain words), or any list of (text, start, end, path, label) that the caller has.

Defined results: null and empty texts have no findings; a text has one row per candidate; rows that repeat
give their findings again; very long texts take time in proportion to their length, marks that open and never close
included; an empty table gives no rows; other columns are ignored, or kept by redact().
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import SLICE_ROWS

#: Rows of the default labelled findings; trees, depth, smallest leaf and seed of the forest.
LABELLED, TREES, DEPTH, LEAF, SEED = 3000, 40, 9, 4, 11
THRESHOLD = 0.5
#: Characters before and after a candidate whose words count as its neighbours.
AROUND = 48
REDACTED = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """gate: lower-case strings of which a match holds one; without any, a word of 32 characters or more."""

    name: str
    gate: tuple[str, ...]
    pattern: re.Pattern
    group: int


_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth(?:orization)?|credentials?|bearer)"
#: Words that stand between a header and its secret.
_SCHEMES = r"(?:bearer|basic|digest|token|apikey|negotiate)"
#: Names, gates and expressions of the rules, in order.
RULES = (
    Rule("private_key", ("-----begin",), re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----[\s\S]{16,}?-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"), 0),
    Rule("cloud_access_key", ("akia", "asia"), re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), 0),
    Rule("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"), re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})\b"), 0),
    Rule("chat_token", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"), 0),
    Rule("payment_key", ("sk_live_", "rk_live_", "sk_test_"), re.compile(r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"), 0),
    Rule("maps_key", ("aiza",), re.compile(r"\bAIza[0-9A-Za-z_-]{35}\b"), 0),
    Rule("package_token", ("npm_", "pypi-"), re.compile(r"\b(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})\b"), 0),
    Rule("mail_key", ("sg.",), re.compile(r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{32,}\b"), 0),
    Rule("web_token", ("eyj",), re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    Rule("url_password", ("://",), re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:([^\s:/@]{3,})@[A-Za-z0-9.-]+"), 1),
    Rule(
        "assignment",
        ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer"),
        re.compile(rf"(?i)(?<![a-z0-9])[a-z0-9_.-]{{0,30}}?{_NAMES}[a-z0-9_.-]{{0,20}}[\"']?\s{{0,3}}(?:=>|:=|[=:]|\bis\b)\s{{0,3}}[\"'`]?(?:{_SCHEMES}[ \t]{{1,3}})?([^\s\"'`,;<>()]{{6,}})"),
        1,
    ),
    Rule("long_hex", (), re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])"), 0),
    Rule("long_base64", (), re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9]|[^\s]{0,200}[0-9])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/=_-])"), 0),
)


@dataclass(frozen=True)
class Candidate:
    rule: int
    start: int
    end: int


_BEGINS, _ENDS = (re.compile(rf"(?=(-----{mark} [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----))") for mark in ("BEGIN", "END"))
_TOKEN_RUN, _TOKEN_START = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\beyJ")


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the private_key rule; every mark is looked at once."""
    ends, k, after = [m.span(1) for m in _ENDS.finditer(text)], 0, 0
    for m in _BEGINS.finditer(text):
        if m.start() < after:
            continue
        while k < len(ends) and ends[k][0] < m.end(1) + 16:
            k += 1
        if k == len(ends):
            return
        after = ends[k][1]
        yield m.start(), after


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the web_token rule: three runs with dots between; every run is looked at once."""
    first = second = None
    for run in (m.span() for m in _TOKEN_RUN.finditer(text)):
        joined = second is not None and second[1] + 1 == run[0] and text[second[1]] == "."
        if first and joined and run[1] - run[0] >= 8 and second[1] - second[0] >= 11 and text.startswith("eyJ", second[0]):
            if start := _TOKEN_START.search(text, first[0], first[1] - 8):
                yield start.start(), run[1]
                first = second = None
                continue
        first, second = second if joined else None, run


#: Rules that are found in one pass, where their expression would scan the same marks or runs again and again.
_FINDERS = {"private_key": _private_keys, "web_token": _web_tokens}


def candidates(text: str) -> list[Candidate]:
    """Candidates of a text by first character; of overlapping ones the earlier rule's, then the first.

    The time is in proportion to the text.
    """
    low = text.lower()
    long_word = max(map(len, text.split()), default=0) >= 32
    taken: list[Candidate] = []
    for k, rule in enumerate(RULES):
        if any(g in low for g in rule.gate) if rule.gate else long_word:
            spans = _FINDERS[rule.name](text) if rule.name in _FINDERS else (m.span(rule.group) for m in rule.pattern.finditer(text))
            taken = _merged(taken, [Candidate(k, *span) for span in spans])
    return taken


def _merged(taken: list[Candidate], found: list[Candidate]) -> list[Candidate]:
    """Both by start: taken, and of found what overlaps nothing taken and no earlier one of found."""
    out, k, end = [], 0, 0
    for c in found:
        while k < len(taken) and taken[k].end <= c.start:
            out.append(taken[k])
            k += 1
        if c.start >= end and (k == len(taken) or taken[k].start >= c.end):
            out.append(c)
            end = c.end
    return out + taken[k:]


#: Words that mark secrets or harmless strings when they stand near, and words of placeholders.
NEAR_SECRET = frozenset("password passwd pwd pass secret token key apikey api auth authorization credential credentials bearer login private access client".split())
NEAR_HARMLESS = frozenset("commit revision sha sha1 sha256 md5 digest checksum hash etag uuid guid id version build integrity fingerprint blob tree parent nonce example sample test dummy fake placeholder docs".split())
CONFIGURATION = frozenset(
    "password secret token example sample test dummy fake your here change changeme admin user root default letmein welcome qwerty please insert value string none null true false "
    "undefined config setting settings environment process http https www com org local localhost server client service account name this that with from have will would there their "
    "about which when what some more time only other first after these could make like just over also back good work year people system program number public private access "
    "key auth login master database production development staging function return class import export const variable getenv environ".split()
)
_LETTERS = re.compile(r"[a-z]{3,}")
#: Letters of a dictionary word at least and at most.
WORD_LETTERS = (3, 12)


@dataclass(frozen=True)
class Lexicon:
    """Dictionary words, and the log-odds of each pair of letters in them against chance."""

    words: frozenset[str]
    pairs: np.ndarray


@cache
def lexicon(vocabulary: str | None = None) -> Lexicon:
    """The words of a tokenizers vocabulary file that start after a space, and the fixed ones."""
    words = set(CONFIGURATION)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            pieces = json.load(f)["model"]["vocab"]
        starts = (piece[1:] for piece in pieces if piece[:1] in ("\u0120", "\u2581"))
        words.update(w for w in starts if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1] and w.isascii() and w.isalpha() and w.islower())
    seen = np.full((26, 26), 0.3)
    for word in words | NEAR_SECRET | NEAR_HARMLESS:
        for a, b in zip(word, word[1:], strict=False):
            if a in string.ascii_lowercase and b in string.ascii_lowercase:
                seen[ord(a) - 97, ord(b) - 97] += 1
    return Lexicon(frozenset(words), np.log(seen / seen.sum() * 676))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _covered(text: str, words: frozenset[str]) -> float:
    """Share of a candidate's characters that the longest dictionary words cover, from left to right."""
    total = 0
    for run in _LETTERS.findall(text.lower()):
        at = 0
        while at < len(run):
            size = next((n for n in range(min(WORD_LETTERS[1], len(run) - at), WORD_LETTERS[0] - 1, -1) if run[at : at + n] in words), 0)
            total += size
            at += size or 1
    return total / max(1, len(text))


def features(text: str, start: int, end: int, rule: int, path: str, known: Lexicon) -> list[float]:
    """The features of one candidate."""
    found = text[start:end]
    size = len(found)
    counts = [sum(map(lambda c: _kind(c) == k, found)) / size for k in range(4)]
    kinds = [_kind(c) for c in found]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, size - 1)
    low = found.lower()
    pairs = [known.pairs[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    share = np.unique(list(found), return_counts=True)[1] / size
    near = re.findall(r"[a-z0-9]+", text[max(0, start - AROUND) : start].lower()) + re.findall(r"[a-z0-9]+", text[end : end + AROUND // 2].lower())
    close = re.findall(r"[a-z0-9]+", text[max(0, start - 16) : start].lower())
    place = re.findall(r"[a-z]+", path.lower())
    return [
        math.log(size),
        *counts,
        changes,
        float(np.mean(pairs)) if pairs else 0.0,
        float(-(share * np.log2(share)).sum()),
        len(share) / size,
        _covered(found, known.words),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", found))),
        float(bool(re.search(r"[${}%]|\.\.\.|\*\*|xxx|\bnull\b", low))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", low))),
        float("/" in found or "\\" in found),
        min(3.0, sum(w in NEAR_SECRET for w in near)),
        min(3.0, sum(w in NEAR_HARMLESS for w in near)),
        float(any(w in NEAR_SECRET for w in close)),
        float(any(w in NEAR_HARMLESS for w in close)),
        float(any(w in ("test", "tests", "example", "examples", "docs", "sample", "fixtures", "mock") for w in place)),
        float(rule),
    ]


class Forest:
    """A random forest for two classes; trees as arrays (feature, threshold, left child, value)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], rng))

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
        best, choice = 1e-9, None
        n, ones = len(y), y.sum()
        impurity = 2 * ones * (n - ones) / n
        for f in rng.permutation(x.shape[1])[: max(2, int(math.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])[:-1]
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF)
            if ok.any():
                right = ones - left
                gain = np.where(ok, impurity - 2 * left * (k - left) / k - 2 * right * (n - k - right) / (n - k), -1)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, choice = gain[i], (int(f), (v[i] + v[i + 1]) / 2)
        return choice

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = [[-1, 0.0, -1, 0.0]]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            nodes[at][3] = float(y[rows].mean())
            split = self._split(x[rows], y[rows], rng) if depth < DEPTH and 0 < nodes[at][3] < 1 and len(rows) >= 2 * LEAF else None
            if split:
                low = x[rows, split[0]] <= split[1]
                nodes[at][:3] = [split[0], split[1], len(nodes)]
                todo += [(len(nodes), rows[low], depth + 1), (len(nodes) + 1, rows[~low], depth + 1)]
                nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[np.arange(len(x)), f] > threshold[at]))
            total += value[at]
        return total / len(self.trees)


def labelled_findings(n: int = LABELLED, seed: int = SEED, vocabulary: str | None = None) -> list[tuple[str, int, int, str, int]]:
    """n labelled findings by rule and seed: (text, start, end, path, 1 for a secret). Paths are drawn alike for both labels."""
    rng = random.Random(seed)
    dictionary = sorted(lexicon(vocabulary).words)
    draw = lambda chars, size: "".join(rng.choice(chars) for _ in range(size))
    hexa, word, mixed = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "!@#%^&*_-+"
    plain = lambda k: " ".join(draw("etaoinshrdlu", rng.randrange(2, 9)) for _ in range(k))
    name = lambda: rng.choice(["password", "token", "api_key", "secret", "auth_token", "access_key", "db_password", "client_secret", "pwd", "API_TOKEN"])
    quote = lambda x: (q := rng.choice(['"', "'", "", ""])) + x + q
    assign = lambda k, x: f"{k}{rng.choice(['=', ' = ', ': ', ':'])}{quote(x)}"
    secret = [
        lambda: (x := draw(hexa, rng.choice([16, 17, 18, 20, 24, 32, 40, 64])), assign(name(), x)),
        lambda: (x := draw(word, rng.randrange(12, 64)), assign(name(), x)),
        lambda: (x := draw(mixed, rng.randrange(8, 24)), assign(rng.choice(["password", "pwd", "db_password", "passwd"]), x)),
        lambda: (x := "".join(draw("etaoinshrdlucmp", rng.randrange(3, 8)) + draw(string.digits, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "!", "#"]), assign(rng.choice(["password", "pwd", "passwd"]), x)),
        lambda: (x := "AKIA" + draw(string.ascii_uppercase + string.digits, 16), rng.choice([x, assign("access_key", x)])),
        lambda: (x := rng.choice(["ghp_", "gho_"]) + draw(word, 36), rng.choice([x, assign("token", x)])),
        lambda: (x := "sk_live_" + draw(word, 24), rng.choice([x, assign("key", x)])),
        lambda: (x := "xoxb-" + draw(string.digits, 12) + "-" + draw(word, 24), x),
        lambda: (x := draw(mixed.replace("@", "").replace(":", ""), rng.randrange(8, 20)), f"postgres://{draw('abcdefgh', 5)}:{x}@db.internal/app"),
        lambda: (x := "-----BEGIN RSA PRIVATE KEY-----\n" + draw(word + "+/", 200) + "\n-----END RSA PRIVATE KEY-----", x),
        lambda: (x := "eyJ" + draw(word, 30) + ".eyJ" + draw(word, 60) + "." + draw(word, 43), f"Authorization: Bearer {x}"),
    ]
    harmless = [
        lambda: (x := draw(hexa, rng.choice([32, 40, 64])), f"{rng.choice(['commit', 'sha256', 'md5', 'checksum', 'revision', 'digest', 'etag', 'integrity'])}{rng.choice([' ', ': ', '=', ' = '])}{x}"),
        lambda: (x := "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), assign(rng.choice(["uuid", "id", "key", "token_id"]), x)),
        lambda: (x := rng.choice(["your_", "my_", "example_", "insert_", "changeme_", "dummy_", "test_"]) + rng.choice(["password", "token_here", "secret", "api_key", "value"]), assign(name(), x)),
        lambda: (x := rng.choice(["${%s}", "{{ %s }}".replace(" ", ""), "%%%s%%", "os.environ.%s", "process.env.%s", "config.%s.value"]) % draw(string.ascii_uppercase, 8), assign(name(), x)),
        lambda: (x := rng.choice(["x", "*", "0", "a", "."]) * rng.randrange(8, 40), assign(name(), x)),
        lambda: (x := rng.choice(dictionary) + rng.choice(["", "_", "-"]) + rng.choice(dictionary), assign(name(), x)),
        lambda: (x := draw("etaoinshrdlu", rng.randrange(6, 14)), f"{rng.choice(['the token is', 'password:', 'secret is', 'keyword:', 'auth:'])} {x}"),
        lambda: (x := "/".join(draw("abcdefghij", 6) for _ in range(7)), assign("path", x)),
        lambda: (x := draw("etaoinshrdlu", rng.randrange(40, 70)) + rng.choice("0123456789"), x),
        lambda: (x := ".".join(str(rng.randrange(30)) for _ in range(4)) + "-build", assign(rng.choice(["auth_version", "token_version", "key_version"]), x)),
    ]
    out = []
    for k in range(n):
        found, statement = rng.choice(secret if k % 2 else harmless)()
        text = f"{plain(rng.randrange(0, 8))} {statement} {plain(rng.randrange(0, 8))}"
        start = text.index(found, text.index(statement))
        out.append((text, start, start + len(found), rng.choice(["src0", "src/app.py", "config/prod.env", "", "web", "docs/readme.md", "tests/fixtures/a.py"]), k % 2))
    return out


@dataclass(frozen=True)
class Model:
    """A forest with the vocabulary file of its dictionary; tasks read the file themselves."""

    forest: Forest
    vocabulary: str | None


def train(findings: list[tuple[str, int, int, str, int]], vocabulary: str | None = None) -> Model:
    """A model from labelled findings (text, start, end, path, label)."""
    rows, labels = [], []
    for text, start, end, path, label in findings:
        rule = next((c.rule for c in candidates(text) if c.start < end and start < c.end), len(RULES))
        rows.append(features(text, start, end, rule, path, lexicon(vocabulary)))
        labels.append(label)
    return Model(Forest(np.array(rows), np.array(labels, float)), vocabulary)


@cache
def default_model(vocabulary: str | None = None) -> Model:
    return train(labelled_findings(vocabulary=vocabulary), vocabulary)


def findings(text: str, path: str, model: Model) -> list[tuple[Candidate, float]]:
    """The candidates of a text with their scores, by place."""
    found = sorted(candidates(text), key=lambda c: c.start) if text else []
    if not found:
        return []
    known = lexicon(model.vocabulary)
    return list(zip(found, model.forest.score(np.array([features(text, c.start, c.end, c.rule, path, known) for c in found])).tolist(), strict=True))


_FOUND = "doc_id long, rule string, start long, length long, secret_sha256 string, score double, kept boolean"


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                ids, texts, paths = (batch.column(k).slice(at, SLICE_ROWS).to_pylist() for k in range(3))
                rows = [
                    (doc_id, RULES[c.rule].name, c.start, c.end - c.start, hashlib.sha256(text[c.start : c.end].encode()).hexdigest(), score, score >= THRESHOLD)
                    for doc_id, text, path in zip(ids, texts, paths, strict=True)
                    for c, score in findings(text or "", path or "", model)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def secret_scan(docs: DataFrame, path_column: str | None = None, vocabulary: str | None = None, model: Model | None = None) -> DataFrame:
    """One row per candidate: doc_id, rule, start and length in characters, secret_sha256, score, kept.

    path_column names a column with the file path or source of a text; it is one of the features. vocabulary is the
    path of a vocabulary file that every machine has; a model of the caller's own brings its own.
    """
    path = F.col(path_column).cast("string") if path_column else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")).mapInArrow(_scan(model or default_model(vocabulary)), _FOUND)


def redacted(text: str, path: str, model: Model) -> str:
    """text with each kept finding replaced."""
    parts, at = [], 0
    for c, score in findings(text, path, model):
        if score >= THRESHOLD:
            parts += [text[at : c.start], REDACTED]
            at = c.end
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, path_column: str | None = None, vocabulary: str | None = None, model: Model | None = None) -> DataFrame:
    """docs with kept findings replaced in text and n_chars, if there is such a column, set anew."""
    model = model or default_model(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                paths = part.column(batch.schema.get_field_index(path_column)).cast(pa.string()).to_pylist() if path_column else [""] * part.num_rows
                texts = [t and redacted(t, p or "", model) for t, p in zip(part.column(k).to_pylist(), paths, strict=True)]
                columns = [pa.array(texts, c.type) if i == k else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
