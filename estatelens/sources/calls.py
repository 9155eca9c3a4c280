"""Calls and module graphs of JavaScript, TypeScript, Go, Java, C, C++, Rust, C# and Python sources.

There are no grammars here: a small tokenizer walks the text once, knows comments, strings, regular expression
literals and nesting, and gives each call's callee, its literal arguments and the literal members of object
arguments. Brackets are matched once with a stack, so time is linear in the text, however deep it nests. What is not
a literal stays unresolved and is not guessed. Rules are a table that calls look up (rules.py); a rule counts only
where its module is imported.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.operators.reach import EXAMPLE_PATH, is_test_path
from estatelens.sources.binaries import python_calls
from estatelens.sources.rules import Rule, guessed, noted, rule_table, with_rules, with_specs

#: Languages by file extension. Larger files are skipped, with a row that says so.
LANGUAGES = {
    "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "python",
    "go": "go", "java": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "rs": "rust", "cs": "csharp",
}
MAX_CHARS = 2 << 20

_COMMENT, _DOUBLE = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\\n])*\""
#: What hides code, by language; a lone slash is a division or, in JavaScript, the start of a regular expression.
_SKIP = {
    "js": re.compile(rf"{_COMMENT}|{_DOUBLE}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|/", re.S),
    "go": re.compile(rf"{_COMMENT}|{_DOUBLE}|'(?:\\.[^'\n]*|[^'\\\n])'|`[^`]*`", re.S),
    "rust": re.compile(rf"{_COMMENT}|r(#+)\".*?\"\1|{_DOUBLE}|'(?:\\.[^'\n]*|[^'\\\n])'", re.S),
    "": re.compile(rf"{_COMMENT}|{_DOUBLE}|'(?:\\.[^'\n]*|[^'\\\n])'", re.S),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: A slash after one of these characters or words starts a regular expression.
_BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%~^<>\n")
_WORD_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|do|else|void|throw|delete|await|yield)\s*$")
_CALLEE = re.compile(r"(?:\bnew\s+)?[A-Za-z_$][\w$]*(?:\s*(?:\.|::|->|\?\.)\s*(?:<[^<>()]*>\s*::\s*)?[A-Za-z_$][\w$]*)*\s*!?\s*\(")
#: Words that stand before a parenthesis and call nothing.
_WORDS = frozenset("if for while switch catch return function func fn match loop sizeof typeof await async elif and or not in with assert defer go using lock".split())
_FUNCTION = re.compile(
    r"\bfunction\s+(\w+)|\bfunc\s+(?:\([^)]*\)\s*)?(\w+)|\bfn\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>"
    r"|\b(?:public|private|protected|static|internal|\w+)\s+[\w<>\[\]*&]+\s+(\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w,\s]+)?\{"
)
_SPACE, _SPACES, _BRACKETS, _LINE = re.compile(r"\s*"), re.compile(r"\s+"), re.compile(r"[(\[{}\]),]"), re.compile("\n")
_NEW, _GENERIC, _IN_LINE = re.compile(r"^new\s+"), re.compile(r"<[^<>]*>::"), re.compile(r"[^\n]")
_NUMBER, _NAME = re.compile(r"[0-9][0-9_]*"), re.compile(r"&?([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)(?:\(\s*\))?")
_MEMBER = re.compile(r"\s*[\"']?([\w$]+)[\"']?\s*:\s*")


def _masked(token: str, c: str) -> str:
    """A token with each character but line ends replaced."""
    return _IN_LINE.sub(c, token) if "\n" in token else c * len(token)


class _Code:
    """A text with comments blank and literals masked, its strings by where they start, and its brackets."""

    def __init__(self, text: str, language: str) -> None:
        self.strings: dict[int, str] = {}
        parts, at, skip = [], 0, _SKIP.get(language, _SKIP[""])
        while m := skip.search(text, at):
            token, start = m[0], m.start()
            parts.append(text[at:start])
            at = m.end()
            if token == "/":
                before = text[max(0, start - 40) : start].rstrip(" \t")
                literal = _REGEX.match(text, start) if not before or before[-1] in _BEFORE_REGEX or _WORD_BEFORE_REGEX.search(before) else None
                token, at = (literal[0], literal.end()) if literal else (token, at)
                parts.append("\x01" * len(token))
            elif token[:2] in ("//", "/*"):
                parts.append(_masked(token, " "))
            else:
                self.strings[start] = token
                parts.append(token[0] + _masked(token[1:-1], "\x01") + token[-1])
        self.code = "".join([*parts, text[at:]])
        self.close: dict[int, int] = {}
        self.commas: dict[int, list[int]] = {}
        stack: list[int] = []
        for m in _BRACKETS.finditer(self.code):
            k, c = m.start(), m[0]
            if c in "([{":
                stack.append(k)
            elif c == ",":
                if stack:
                    self.commas.setdefault(stack[-1], []).append(k)
            elif stack:
                self.close[stack.pop()] = k

    def end(self, opened: int) -> int:
        """Where the bracket that opens at a place is closed; the end of the text if it is not."""
        return self.close.get(opened, len(self.code))

    def parts(self, opened: int) -> list[tuple[int, int]]:
        """Ranges between the commas of one bracket."""
        edges, end = [opened, *self.commas.get(opened, ())], self.end(opened)
        out = [(a + 1, b) for a, b in zip(edges, [*edges[1:], end], strict=True)]
        if self.lead(out[-1][0]) >= out[-1][1]:
            out.pop()
        return out

    def lead(self, at: int) -> int:
        """The first place from at on without white space."""
        return _SPACE.match(self.code, at).end() if self.code[at : at + 1].isspace() else at

    def value(self, start: int, end: int) -> str | None:
        """A string, number, boolean, name or call as text; null if it is an expression. Reads no more than the token."""
        lead = self.lead(start)
        whole = lambda at: at <= end and (at == end or self.lead(at) >= end)
        if lead in self.strings:
            literal = self.strings[lead]
            if not whole(lead + len(literal)) or literal[0] == "`" and "${" in literal:
                return None
            return literal.strip("r#")[1:-1] if literal[0] == "r" else literal[1:-1]
        if (m := _NUMBER.match(self.code, lead)) and whole(m.end()):
            return m[0].replace("_", "")
        return m[1] if (m := _NAME.match(self.code, lead)) and whole(m.end()) else None

    def members(self, opened: int) -> dict[str, str]:
        """Literal members of an object; of a list, its first element."""
        out = {}
        for a, b in self.parts(opened):
            if pair := _MEMBER.match(self._plain(a, b), 0):
                at = a + pair.end()
                listed = self.code[at : at + 1] == "["
                inner = self.parts(at) if listed else []
                value = self.value(*inner[0]) if inner else None if listed else self.value(at, b)
                if value is not None:
                    out[pair[1]] = value
        return out

    def _plain(self, a: int, b: int) -> str:
        """The start of a member with a quoted name put back."""
        lead = self.lead(a)
        head = self.strings.get(lead, "")
        return self.code[a:lead] + head + self.code[lead + len(head) : min(b, lead + len(head) + 200)]

    def functions(self) -> list[tuple[int, int, str]]:
        """(start, end, name) of functions; without a body in braces the body ends with the line."""
        out = []
        for m in _FUNCTION.finditer(self.code):
            name = next(g for g in m.groups() if g)
            if m[0].endswith("{"):
                brace = m.end() - 1
            else:
                at = self.code.find("(", m.end()) if not m[0].endswith("=>") else m.end()
                after = self.end(at) + 1 if at >= 0 and not m[0].endswith("=>") else m.end()
                found = re.compile(r"[{;]" if not m[0].endswith("=>") else r"\S").search(self.code, after)
                brace = found.start() if found and found[0] == "{" else -1
            stop = self.code.find("\n", m.end())
            out.append((m.start(), self.end(brace) if brace >= 0 else stop if stop >= 0 else len(self.code), name))
        return out


def scan(text: str, language: str = "js") -> list[tuple[int, str | None, str, list[str | None], dict[str, str]]]:
    """Calls of a text: line, innermost function around it, callee, arguments, members of object arguments."""
    source = _Code(text, language)
    code, functions = source.code, source.functions()
    lines = [m.start() for m in _LINE.finditer(code)]
    out, around, following = [], [], 0
    for m in _CALLEE.finditer(code):
        while following < len(functions) and functions[following][0] <= m.start():
            around.append(functions[following])
            following += 1
        while around and around[-1][1] < m.start():
            around.pop()
        callee = _SPACES.sub("", _GENERIC.sub("", _NEW.sub("", m[0][:-1]))).replace("?.", ".").rstrip("!")
        if callee in _WORDS or "\x01" in callee:
            continue
        values, members = [], {}
        for a, b in source.parts(m.end() - 1):
            values.append(source.value(a, b))
            lead = source.lead(a)
            if code[lead : lead + 1] == "{":
                members |= source.members(lead)
        # a call in a function's own header is made where the function stands
        inner = next((f[2] for f in reversed(around) if f[0] < m.start()), None)
        out.append((bisect.bisect_left(lines, m.start()) + 1, inner, callee, values, members))
    return out


_IMPORTS = {
    "js": re.compile(
        r"\bimport\s+(?:type\s+)?(?:(?P<names>[\w$*{},\s]+?)\s+from\s+)?['\"](?P<a>[^'\"]+)['\"]"
        r"|(?:(?:const|let|var)\s+(?P<names2>[\w${},:\s]+?)\s*=\s*)?\brequire\(\s*['\"](?P<b>[^'\"]+)['\"]\s*\)"
    ),
    "go": re.compile(r"(?m)^\s*(?:import\s+)?(?P<names>[\w.]+\s+)?\"(?P<a>[\w./-]+)\"\s*$|\bimport\s+\"(?P<b>[\w./-]+)\""),
    "java": re.compile(r"\bimport\s+(?:static\s+)?(?P<a>[\w.]+)(?:\.\*)?\s*;"),
    "c": re.compile(r"#\s*include\s*[<\"](?P<a>[^>\"]+)[>\"]"),
    "csharp": re.compile(r"\busing\s+(?:static\s+)?(?:(?P<names>\w+)\s*=\s*)?(?P<a>[\w.]+)\s*;"),
}
_USE = re.compile(r"\buse\s+([^;]+);")


def _rust_uses(tree: str, prefix: str = "") -> list[tuple[str, str]]:
    """(alias, path) of a use declaration with nested braces and renames."""
    tree, out, depth, start = tree.strip(), [], 0, 0
    parts = []
    for k, c in enumerate(tree + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(tree[start:k].strip())
            start = k + 1
    for part in filter(None, parts):
        if part.endswith("}"):
            head, _, inner = part.partition("{")
            out += _rust_uses(inner[:-1], prefix + head)
            continue
        path, _, renamed = (prefix + part).partition(" as ")
        path = path.strip().removesuffix("::self").removesuffix("::*")
        out.append((renamed.strip() or path.rpartition("::")[2], path))
    return out


def imports_of(text: str, language: str, found: list[re.Match] | None = None) -> list[tuple[str, str]]:
    """(alias, module) of a text's imports; the alias of a whole module is its last part, of a renamed one its new name.

    found: the places of imports, where they are known already.
    """
    if language == "python":
        parsed_text = python_calls(text)
        return parsed_text[1] if parsed_text else []
    if language == "rust":
        return [u for m in _USE.finditer(text) for u in _rust_uses(re.sub(r"\s+", " ", m[1]))]
    out = []
    for m in _IMPORTS[language].finditer(text) if found is None else found:
        groups = m.groupdict()
        module = groups.get("a") or groups.get("b")
        if not module:
            continue
        names = groups.get("names") or groups.get("names2") or ""
        aliases = [re.split(r"\sas\s|:", x)[-1].strip() for x in re.sub(r"[{}]|\*\s+as\s", " ", names).split(",")]
        last = re.split(r"[/.:]+", re.sub(r"\.(?:h|hpp|c|cpp)$", "", module))[-1]
        out += [(a, module) for a in aliases if re.fullmatch(r"[\w$]+", a)] or [(last, module)]
    return out


def renamed_of(text: str, found: list[re.Match] | None = None) -> dict[str, str]:
    """Local name -> exported name of JavaScript imports that rename ({ createHash as h }, { createHash: h })."""
    out = {}
    for m in _IMPORTS["js"].finditer(text) if found is None else found:
        names = m["names"] or m["names2"] or ""
        for x in re.sub(r"[{}]", " ", names).split(","):
            pair = re.split(r"\sas\s|:", x)
            if len(pair) == 2 and pair[0].strip() not in ("*", ""):
                out[pair[1].strip()] = pair[0].strip()
    return out


#: Imports that show that a file of a language uses cryptography; a file without imports is not judged by them.
GATES = {
    "java": re.compile(r"^(javax\.crypto|java\.security|org\.bouncycastle)"),
    "csharp": re.compile(r"System\.Security\.Cryptography|BouncyCastle"),
}


def resolved_calls(text: str, language: str) -> list[tuple] | None:
    """Calls with aliases resolved: (line, function, callee, arguments, members, module, gated); null if the text does not parse."""
    found = resolved(text, language)
    return found and found[0]


def resolved(text: str, language: str) -> tuple[list[tuple], list[tuple[str, str]]] | None:
    """resolved_calls() and imports_of() of a text that is parsed once; null if it does not parse."""
    if language == "python":
        found = python_calls(text)
        if not found:
            return None
        known = dict(found[1])
        return [(line, f, c, a, {k: v for k, v in kw.items() if v is not None}, known.get(c.split(".")[0]), True) for line, f, c, a, kw in found[0]], found[1]
    places = list(_IMPORTS[language].finditer(text)) if language in _IMPORTS else None
    imports = imports_of(text, language, places)
    modules, renamed, gate = dict(imports), renamed_of(text, places) if language == "js" else {}, GATES.get(language)
    gated = gate is None or not imports or any(gate.search(m) for _, m in imports)
    out = []
    for line, f, c, a, o in scan(text, language):
        head = re.match(r"[\w$]+", c)
        name, rest = (head[0], c[head.end() :]) if head else (c, "")
        module = modules.get(name)
        if name in renamed:
            name = renamed[name]
        elif module and language == "rust":
            name = module
        elif module and language in ("go", "csharp"):
            name = re.split(r"[/.]", module)[-1]
        out.append((line, f, name + rest, a, o, module, gated))
    return out, imports


def exports_of(text: str, language: str) -> list[str]:
    """Names that other files can use."""
    if language == "js":
        found = re.findall(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+(\w+)", text) + re.findall(r"\bexports\.(\w+)\s*=", text)
        for block in re.findall(r"\bexport\s*\{([^}]*)\}|module\.exports\s*=\s*\{([^}]*)\}", text):
            found += [x.split(" as ")[0].split(":")[0].strip() for x in "".join(block).split(",")]
        return sorted({x for x in found if x})
    pattern = {"python": r"(?m)^(?:async\s+)?(?:def|class)\s+([A-Za-z]\w*)", "go": r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Z]\w*|main)", "rust": r"\bpub\s+(?:async\s+)?fn\s+(\w+)|\bfn\s+(main)\b", "java": r"\bpublic\s+[\w<>\[\]\s]+?\s(\w+)\s*\(", "csharp": r"\bpublic\s+[\w<>\[\]\s]+?\s(\w+)\s*\(", "c": r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*?\)\s*\{"}[language]
    return sorted({y for x in re.findall(pattern, text) for y in ([x] if isinstance(x, str) else x) if y})


_CALLS = "path string, language string, line int, function string, callee string, args array<string>, kwargs map<string,string>, module string, gated boolean, problem string"


def language_of(path: Column) -> Column:
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def _languages(files: DataFrame) -> DataFrame:
    return files.select("path", "text", language_of(F.col("path")).alias("language")).filter("language is not null")


#: Parsed sources: what calls() and module_graph() are cut from.
_PARSED = (
    "path string, language string, problem string, calls array<struct<line:int,function:string,callee:string,args:array<string>,kwargs:map<string,string>,module:string,gated:boolean>>, "
    "imports array<struct<alias:string,spec:string,ordinal:int>>, exported array<string>"
)
_CALL_FIELDS = ("line", "function", "callee", "args", "kwargs", "module", "gated")
_CALL = pa.struct([("line", pa.int32()), ("function", pa.string()), ("callee", pa.string()), ("args", pa.list_(pa.string())), ("kwargs", pa.map_(pa.string(), pa.string())), ("module", pa.string()), ("gated", pa.bool_())])
_IMPORT = pa.struct([("alias", pa.string()), ("spec", pa.string()), ("ordinal", pa.int32())])
_PARSED_ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("problem", pa.string()), ("calls", pa.list_(_CALL)), ("imports", pa.list_(_IMPORT)), ("exported", pa.list_(pa.string()))])


def parsed(files: DataFrame, names: bool = True) -> DataFrame:
    """One row per source (path, text) of a known language, each parsed once; a file that cannot be read has a problem.

    names: whether imports and exported are wanted; else they are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text, language in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), batch["language"].to_pylist(), strict=True):
                text = text or ""
                found = resolved(text, language) if len(text) <= MAX_CHARS else None
                if found is None:
                    rows.append((path, language, "does not parse" if len(text) <= MAX_CHARS else "too large", [], [], []))
                    continue
                made = [(line, f, c, a, list(kw.items()), module, gated) for line, f, c, a, kw, module, gated in found[0]]
                imports, exported = [], []
                if names:
                    imports = [(a, s.rpartition(".")[0] if language == "python" and s.startswith(".") else s, k) for k, (a, s) in enumerate(found[1])]
                    exported = exports_of(text, language)
                rows.append((path, language, None, made, imports, exported))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED_ARROW, strict=True)], schema=_PARSED_ARROW)

    return _languages(files).mapInArrow(run, _PARSED)


def calls_of(sources: DataFrame) -> DataFrame:
    """Calls of parsed sources, with the module that the callee's first name stands for; skipped files give a problem."""
    each = sources.select("path", "language", "problem", F.explode_outer("calls").alias("c")).filter("c is not null or problem is not null")
    return each.select("path", "language", *[F.col(f"c.{x}").alias(x) for x in _CALL_FIELDS], "problem")


def calls(files: DataFrame) -> DataFrame:
    return calls_of(parsed(files, names=False))


#: What marks a file as a place where execution starts, in the order in which it is asked: languages, kind,
#: what the path must match (none: any), what the text must match.
_NATIVE = ("go", "java", "c", "rust", "csharp")
ENTRIES = (
    (_NATIVE, "framework-route", None, r"http\.ListenAndServe|gin\.Default|echo\.New|net\.Listen|SpringApplication\.run|@RestController|actix_web::HttpServer|axum::Server|rocket::build|WebApplication\.CreateBuilder|app\.MapGet"),
    (_NATIVE, "package-main", None, r"\bfunc\s+main\s*\(|\bfn\s+main\s*\(|\bint\s+main\s*\(|public\s+static\s+void\s+main\s*\(|static\s+(?:async\s+)?(?:void|int|Task)\s+Main\s*\("),
    (("python",), "python-wsgi", r"(^|/)(wsgi|asgi|manage)\.py$", None),
    (("python",), "python-main", None, r"if\s+__name__\s*==\s*['\"]__main__['\"]"),
    (("python",), "framework-route", None, r"Flask\s*\(|FastAPI\s*\(|urlpatterns\s*=|application\s*=\s*get_[wa]sgi_application"),
    (("js",), "framework-route", r"(^|/)(app|pages)/.*/(route|page|layout)\.[jt]sx?$|(^|/)pages/api/", None),
    (("js",), "http-server", None, r"\.listen\s*\(|createServer\s*\(|app\.(get|post|put|delete|patch|use)\s*\(|new\s+Hono\s*\(|fastify\s*\("),
    (("js",), "package-bin", r"(^|/)(server|main|index|cli|bin)\.[jt]sx?$", r"^#!|process\.argv"),
)


def entry_kind(path: Column, text: Column, language: Column) -> Column:
    """How execution starts in a file, by the first row of ENTRIES that fits; null if none does."""
    fits = [
        F.when(language.isin(*languages) & (path.rlike(place) if place else F.lit(True)) & (text.rlike(mark) if mark else F.lit(True)), kind)
        for languages, kind, place, mark in ENTRIES
    ]
    return F.coalesce(*fits)


def module_graph(files: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vertices, imports, exports and call edges of sources (path, text, package, published), for estatelens.operators.reach.

    sources: the files as parsed() gave them, so that no file is parsed again.
    """
    sources = parsed(files) if sources is None else sources
    facts = files.select(
        F.col("path").alias("file"), "package", "published", is_test_path(F.col("path")).alias("is_test"), entry_kind(F.col("path"), F.col("text"), language_of(F.col("path"))).alias("entry_kind")
    )
    vertices = sources.select(F.col("path").alias("file"), F.col("language").alias("lang")).join(facts, "file")
    imports = sources.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.spec", "i.ordinal").distinct()
    exported = sources.select(F.col("path").alias("file"), F.explode("exported").alias("name"))
    called = sources.select(F.col("path").alias("file"), F.explode("calls").alias("c"))
    edges = called.select("file", F.coalesce("c.function", F.lit("")).alias("caller"), F.regexp_extract("c.callee", r"([^.:>]*)$", 1).alias("callee")).distinct()
    return vertices, imports, exported.union(edges.filter("caller = ''").select("file", "callee")).distinct(), edges


def packages_of(manifests: DataFrame) -> DataFrame:
    """Packages of package.json files (path, text): dir, name, entry_dir, published (not private)."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.get_json_object("text", "$.name")
    return manifests.filter(F.col("path").rlike(r"(^|/)package\.json$")).select(folder.alias("dir"), name.alias("name"), folder.alias("entry_dir"), (name.isNotNull() & ~F.coalesce(F.get_json_object("text", "$.private") == "true", F.lit(False))).alias("published"))


def with_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files (path, ...) with package, the dir of the nearest package above, and published: its name can be imported and
    the file is neither test nor example. Each file asks for its own folders, so no pair of file and package is formed."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir")).distinct()
    near = above.join(packages.select("dir", "published"), "dir").groupBy("path").agg(F.max_by(F.struct("dir", "published"), F.length("dir")).alias("p"))
    aside = F.col("path").rlike(EXAMPLE_PATH) | is_test_path(F.col("path"))
    return files.join(near, "path", "left").select(files["*"], F.col("p.dir").alias("package"), (F.coalesce("p.published", F.lit(False)) & ~aside).alias("published"))


def call_findings(rows: DataFrame, system_id: str, own_rules: tuple[Rule, ...] | list[Rule] | DataFrame = ()) -> DataFrame:
    """Findings of call rows of all languages but Python, whose rules stand with its parser.

    own_rules: rules of the caller, which count before the fixed ones. raw is the callee, the purpose, and whether the
    call settles it (RESOLVED) or the rule guesses it (RULE_DEFAULT), and the rule's note, if any.
    """
    known = rows.filter("callee is not null and language <> 'python'").drop("problem")
    # explode() would filter on the specs, and so write them out again below every step that they are made in
    found = with_specs(with_rules(known, rule_table(rows.sparkSession, own_rules))).select("*", F.explode_outer("specs").alias("spec")).filter("spec is not null")
    purpose = F.coalesce("spec.purpose", F.lit("DATA_ENCRYPTION"))
    raw = F.concat(F.col("callee"), F.lit(" purpose="), purpose, F.when(guessed(), "(RULE_DEFAULT)").otherwise("(RESOLVED)"), F.coalesce(F.concat(F.lit(" note="), noted()), F.lit("")))
    return found.select(
        F.lit(system_id).alias("system_id"), "spec.primitive", "spec.parameters", purpose.alias("purpose"), F.lit("SELF").alias("control_class"), F.lit("SOURCE_AST").alias("modality"),
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("locator"), raw.alias("raw"), F.lit(None).cast("string").alias("assumption"),
    )
