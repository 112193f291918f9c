"""Source texts as chunks and imports.

One table gives, for each language, the line patterns that open a chunk, its type and how its end is found. A
single scanner reads the table; it runs over Arrow batches, a file at a time, since where a chunk ends depends
on all lines before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 50
_ID = r"[A-Za-z_$][\w$]*"

#: language -> [(pattern with group 'name', chunk type, end rule)]
_BRACES = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})", "function", "brace"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})", "class", "brace"),
    (rf"^\s*(?:export\s+)?interface\s+(?P<name>{_ID})", "interface", "brace"),
    (rf"^\s*(?:export\s+)?type\s+(?P<name>{_ID})\s*(?:<[^>]*>)?\s*=", "type", "statement"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>", "function", "brace"),
    (rf"^\s*(?:module\.)?exports\.(?P<name>{_ID})\s*=\s*(?:async\s+)?function", "function", "brace"),
    (rf"^\s*{_ID}\.prototype\.(?P<name>{_ID})\s*=\s*function", "method", "brace"),
]
_JVM = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|open|data|partial|readonly|suspend|inline)\s+)*"
CHUNKS: dict[str, list[tuple[str, str, str]]] = {
    "typescript": _BRACES,
    "javascript": _BRACES,
    "python": [(r"^\s*(?:async\s+)?def\s+(?P<name>\w+)", "function", "indent"), (r"^\s*class\s+(?P<name>\w+)", "class", "indent")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", "function", "brace"), (r"^type\s+(?P<name>\w+)\s+interface", "interface", "brace"), (r"^type\s+(?P<name>\w+)\s+struct", "class", "brace"), (r"^type\s+(?P<name>\w+)", "type", "line")],
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)", "function", "brace"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(?P<name>\w+)", "class", "brace"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)", "interface", "brace"), (r"^impl(?:<[^>]*>)?\s+(?P<name>[\w:]+)", "block", "brace")],
    "java": [(rf"^\s*{_JVM}(?:class|enum|record)\s+(?P<name>\w+)", "class", "brace"), (rf"^\s*{_JVM}@?interface\s+(?P<name>\w+)", "interface", "brace"), (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\(", "method", "brace")],
    "csharp": [(rf"^\s*{_JVM}(?:class|struct|record|enum)\s+(?P<name>\w+)", "class", "brace"), (rf"^\s*{_JVM}interface\s+(?P<name>\w+)", "interface", "brace"), (r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)+[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*(?:<[^>]*>)?\(", "method", "brace")],
    "c": [(r"^(?:typedef\s+)?(?:struct|union|enum)\s+(?P<name>\w+)\s*\{", "class", "brace"), (r"^(?!return|else|if|while|for|switch)[A-Za-z_][\w\s*]*?[\s*](?P<name>\w+)\s*\([^;]*$", "function", "brace")],
    "ruby": [(r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)", "function", "end"), (r"^\s*class\s+(?P<name>[\w:]+)", "class", "end"), (r"^\s*module\s+(?P<name>[\w:]+)", "module", "end")],
    "php": [(rf"^\s*{_JVM}function\s+&?(?P<name>\w+)", "function", "brace"), (rf"^\s*{_JVM}(?:class|trait|enum)\s+(?P<name>\w+)", "class", "brace"), (r"^\s*interface\s+(?P<name>\w+)", "interface", "brace")],
    "kotlin": [(rf"^\s*{_JVM}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)", "function", "brace"), (rf"^\s*{_JVM}(?:class|object|enum class)\s+(?P<name>\w+)", "class", "brace"), (rf"^\s*{_JVM}interface\s+(?P<name>\w+)", "interface", "brace")],
    "scala": [(rf"^\s*{_JVM}def\s+(?P<name>\w+)", "function", "brace"), (rf"^\s*{_JVM}(?:case\s+)?(?:class|object)\s+(?P<name>\w+)", "class", "brace"), (rf"^\s*{_JVM}trait\s+(?P<name>\w+)", "interface", "brace")],
    "swift": [(rf"^\s*{_JVM}func\s+(?P<name>\w+)", "function", "brace"), (rf"^\s*{_JVM}(?:class|struct|enum|actor|extension)\s+(?P<name>\w+)", "class", "brace"), (r"^\s*(?:public\s+)?protocol\s+(?P<name>\w+)", "interface", "brace")],
    "dart": [(r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(?P<name>\w+)", "class", "brace"), (r"^\s*(?:static\s+)?[\w<>?\[\]]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:async\s*)?\{", "function", "brace")],
    "elixir": [(r"^\s*defp?\s+(?P<name>[\w?!]+)", "function", "end"), (r"^\s*defmodule\s+(?P<name>[\w.]+)", "module", "end"), (r"^\s*defprotocol\s+(?P<name>[\w.]+)", "interface", "end")],
    "lua": [(r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)", "function", "end"), (r"^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function", "function", "end")],
    "zig": [(r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+(?P<name>\w+)", "function", "brace"), (r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)", "class", "brace")],
    "haskell": [(r"^(?:data|newtype)\s+(?P<name>\w+)", "type", "indent"), (r"^class\s+(?:.*=>\s*)?(?P<name>\w+)", "interface", "indent"), (r"^(?P<name>[a-z]\w*'?)\s*::", "function", "same")],
    "clojure": [(r"^\(defn-?\s+(?P<name>[^\s\[]+)", "function", "paren"), (r"^\((?:defprotocol|definterface)\s+(?P<name>\S+)", "interface", "paren"), (r"^\((?:defrecord|deftype)\s+(?P<name>\S+)", "class", "paren")],
    "ocaml": [(r"^\s*let\s+(?:rec\s+)?(?P<name>\w+)", "function", "indent"), (r"^\s*type\s+(?P<name>\w+)", "type", "indent"), (r"^\s*module\s+(?P<name>\w+)", "module", "indent")],
}
CHUNKS["cpp"] = [(r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<name>\w+)[^;]*$", "class", "brace"), (r"^\s*namespace\s+(?P<name>\w+)", "module", "brace"), (r"^(?!return|else|if|while|for|switch)[A-Za-z_][\w\s*&<>:,]*?[\s*&](?P<name>[\w:~]+)\s*\([^;]*$", "function", "brace")]

_JS_IMPORTS = [r"^\s*import\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*from\s*['\"](?P<source>[^'\"]+)['\"]", r"^\s*export\s+(?P<names>\{[^}]*\}|\*)\s*from\s*['\"](?P<source>[^'\"]+)['\"]", r"^\s*import\s*['\"](?P<source>[^'\"]+)['\"]", r"(?:const|let|var)\s+(?P<names>[^=]+?)\s*=\s*require\(\s*['\"](?P<source>[^'\"]+)['\"]"]
IMPORTS: dict[str, list[str]] = {
    "typescript": _JS_IMPORTS,
    "javascript": _JS_IMPORTS,
    "python": [r"^\s*from\s+(?P<source>[.\w]+)\s+import\s+(?P<names>[^#]+)", r"^\s*import\s+(?P<source>[\w.]+)"],
    "go": [r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<source>[^\"]+)\"\s*$"],
    "rust": [r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+)(?:::\{(?P<names>[^}]*)\})?"],
    "java": [r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+)"],
    "csharp": [r"^\s*using\s+(?:static\s+)?(?P<source>[\w.]+)\s*;"],
    "c": [r"^\s*#include\s*[\"<](?P<source>[^\">]+)[\">]"],
    "ruby": [r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)"],
    "php": [r"^\s*use\s+(?P<source>[\w\\]+)", r"^\s*(?:require|include)(?:_once)?\s*\(?['\"](?P<source>[^'\"]+)"],
    "elixir": [r"^\s*(?:alias|import|use|require)\s+(?P<source>[\w.]+)"],
    "lua": [r"require\s*\(?['\"](?P<source>[^'\"]+)"],
    "zig": [r"@import\(\"(?P<source>[^\"]+)\"\)"],
    "haskell": [r"^import\s+(?:qualified\s+)?(?P<source>[\w.]+)"],
    "ocaml": [r"^\s*open\s+(?P<source>[\w.]+)"],
}
for _l, _like in (("cpp", "c"), ("kotlin", "java"), ("scala", "java"), ("swift", "java")):
    IMPORTS[_l] = IMPORTS[_like]
IMPORTS["dart"] = [r"^\s*import\s+['\"](?P<source>[^'\"]+)"]

_COMPILED: dict[str, tuple[list, list]] = {}


def _tables(lang: str) -> tuple[list, list]:
    if lang not in _COMPILED:
        _COMPILED[lang] = ([(re.compile(p), t, e) for p, t, e in CHUNKS.get(lang, [])], [re.compile(p) for p in IMPORTS.get(lang, [])])
    return _COMPILED[lang]


def _depth(lines: list[str], start: int, open_: str, close: str, fallback: int = 50) -> int:
    """Last line of the bracketed block that opens at or after ``start``."""
    depth, seen = 0, False
    for i in range(start, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
        for c in code:
            if c == open_:
                depth, seen = depth + 1, True
            elif c == close:
                depth -= 1
        if seen and depth <= 0:
            return i
        if not seen and (i - start >= 5 or code.rstrip().endswith(";")):
            return i if code.rstrip().endswith(";") else start
    return min(len(lines) - 1, start + fallback)


def _indent(lines: list[str], start: int) -> int:
    """Last line that is deeper than the first."""
    margin, last = len(lines[start]) - len(lines[start].lstrip()), start
    for i in range(start + 1, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= margin and not lines[i].lstrip().startswith((")", "]", "}")):
                break
            last = i
    return last


def _keyword_end(lines: list[str], start: int, limit: int = 100) -> int:
    """The line whose 'end' closes the block of ``start``, by indentation."""
    margin = len(lines[start]) - len(lines[start].lstrip())
    if re.search(r",\s*do:|\bend\s*$", lines[start]):
        return start
    for i in range(start + 1, min(len(lines), start + limit)):
        if re.match(r"\s*end\b", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) <= margin:
            return i
    return min(len(lines) - 1, start + limit)


def block_end(lines: list[str], start: int, rule: str, name: str = "") -> int:
    if rule == "brace":
        return _depth(lines, start, "{", "}")
    if rule == "paren":
        return _depth(lines, start, "(", ")")
    if rule == "indent":
        return _indent(lines, start)
    if rule == "end":
        return _keyword_end(lines, start)
    if rule == "statement":
        for i in range(start, min(len(lines), start + 20)):
            if lines[i].rstrip().endswith(";"):
                return i
        return start
    if rule == "same":  # equations of one function
        i = start
        while i + 1 < len(lines) and (not lines[i + 1].strip() or lines[i + 1].startswith((" ", f"{name} "))):
            i += 1
        return i
    return start


def _windows(lines: list[str]) -> list[tuple]:
    return [("block", f"lines {a + 1}", a + 1, min(a + WINDOW, len(lines)), "\n".join(lines[a : a + WINDOW])) for a in range(0, len(lines), WINDOW)]


def _header(lines: list[str], first: int) -> list[tuple]:
    """The comment that opens a file, if it says something: two lines and sixty characters at least."""
    n = 0
    while n < min(60, len(lines), first) and (not lines[n].strip() or re.match(r"\s*(//|#|/?\*|--|;|\"\"\")", lines[n])):
        n += 1
    text = "\n".join(lines[:n]).rstrip()
    return [("module", "_module", 1, n, text)] if len([x for x in text.split("\n") if x.strip()]) >= 2 and len(text) >= 60 else []


def parse_markdown(text: str) -> list[tuple]:
    """Sections under a breadcrumb of headings, and fenced blocks; '#' within a fence is no heading."""
    out, stack, fence = [], [], None
    start, body = 1, []

    def close(upto: int) -> None:
        if any(x.strip() for x in body):
            out.append(("doc_section", " > ".join(h for _, h in stack) or "_top", start, upto, "\n".join(body)))

    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        if m := re.match(r"\s*(```|~~~)\s*(\S*)", line):
            if fence is None:
                fence = (i, m[1], m[2])
            elif fence[1] == m[1]:
                out.append(("doc_code", fence[2] or "text", fence[0], i, "\n".join(lines[fence[0] : i - 1])))
                fence = None
        elif fence is None and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)):
            close(i - 1)
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            start, body = i, []
        body.append(line)
    close(len(lines))
    return out


def parse_notebook(text: str) -> list[tuple]:
    """Markdown cells as sections, code cells as blocks; a broken notebook gives nothing."""
    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return []
    out, line = [], 1
    for k, cell in enumerate(cells if isinstance(cells, list) else []):
        source = cell.get("source", "") if isinstance(cell, dict) else ""
        source = "".join(source) if isinstance(source, list) else str(source)
        n = source.count("\n") + 1
        if isinstance(cell, dict) and cell.get("cell_type") == "markdown":
            out += [(t, name, a + line - 1, b + line - 1, body) for t, name, a, b, body in parse_markdown(source)]
        elif isinstance(cell, dict) and cell.get("cell_type") == "code" and source.strip():
            out.append(("block", f"cell {k}", line, line + n - 1, source))
        line += n
    return out


#: What makes a value of a component's script reactive.
_REACTIVE = re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(ref|shallowRef|reactive|computed|readonly|toRefs?|defineProps|defineEmits|defineModel|withDefaults|use[A-Z]\w*)\b", re.M)
_OUTSIDE_MARKUP = re.compile(r"<!--.*?-->|\{\{.*?\}\}|=\s*\"[^\"]*\"|=\s*'[^']*'", re.S)


def vue_components(template: str) -> list[str]:
    """Names of the components that a template uses, in PascalCase; comments, attribute values and interpolations hold none."""
    tags = re.findall(r"<([A-Z]\w*|[a-z][a-z0-9]*(?:-[a-z0-9]+)+)(?=[\s/>])", _OUTSIDE_MARKUP.sub("", template))
    return sorted({t if t[0].isupper() else "".join(part.capitalize() for part in t.split("-")) for t in tags})


def parse_vue(text: str) -> tuple[list[tuple], list[tuple]]:
    """Template, scripts, style and custom blocks; the scripts' own chunks, reactive values and imports; components used.

    A component may have a plain script and one with ``setup``: both give their symbols, that with ``setup`` first.
    """
    out, imports, scripts = [], [], []
    for m in re.finditer(r"^<(template|script|style|[a-z][\w-]*)\b([^>]*)>(.*?)^</\1\s*>", text, re.S | re.M | re.I):
        tag, first = m[1].lower(), text.count("\n", 0, m.start()) + 1
        out.append(("block", tag, first, first + m[0].count("\n"), m[0]))
        if tag == "script":
            scripts.append((not re.search(r"\bsetup\b", m[2]), first, "typescript" if re.search(r"lang\s*=\s*[\"']tsx?[\"']", m[2], re.I) else "javascript", m[3]))
        elif tag == "template":
            imports += [(name, name, False) for name in vue_components(m[3])]
    for _, first, lang, body in sorted(scripts, key=lambda x: x[:2]):
        chunks, found = parse_code(body, lang)
        named = [(t, n, a + first - 1, b + first - 1, part) for t, n, a, b, part in chunks if t != "block"]
        seen = {n for _, n, *_ in named}
        lines = body.split("\n")
        for m in _REACTIVE.finditer(body):
            if m[1] not in seen:
                at = body.count("\n", 0, m.start())
                named.append(("variable", m[1], first + at, first + at, lines[at]))
        out += named
        imports += [x for x in found if x not in imports]
    return out, imports


def parse_code(text: str, lang: str) -> tuple[list[tuple], list[tuple]]:
    """((type, name, start, end, content)..., (source, names, is_relative)...) of a text."""
    if lang == "markdown":
        return parse_markdown(text), []
    if lang == "notebook":
        return parse_notebook(text), []
    if lang == "vue":
        return parse_vue(text)
    openers, sources = _tables(lang)
    lines = text.split("\n")
    chunks, imports = [], []
    for i, line in enumerate(lines):
        for pattern, kind, rule in openers:
            if m := pattern.match(line):
                end = block_end(lines, i, rule, m["name"])
                # a function within a class of the same file is a method
                inner = kind == "function" and any(c[0] == "class" and c[2] <= i + 1 <= c[3] for c in chunks)
                chunks.append(("method" if inner else kind, m["name"], i + 1, end + 1, "\n".join(lines[i : end + 1])))
                break
        for pattern in sources:
            if m := pattern.search(line):
                got = m.groupdict()
                names = re.findall(r"[\w$*]+", re.sub(r"\bas\s+\w+|\btype\s+", "", got.get("names") or ""))
                imports.append((got["source"], ",".join(names), got["source"].startswith(".")))
                break
    if not chunks:
        return (_windows(lines) if text.strip() else []), imports
    return _header(lines, chunks[0][2] - 1) + chunks, imports


CHUNK_SCHEMA = "path string, type string, name string, start_line int, end_line int, content string"
IMPORT_SCHEMA = "path string, source string, names string, is_relative boolean"


def _batches(which: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = [(path, *r) for r in parse_code(text or "", lang)[which]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of files(path, language, text)."""
    s, i = pa.string(), pa.int32()
    schema = pa.schema([("path", s), ("type", s), ("name", s), ("start_line", i), ("end_line", i), ("content", s)])
    return files.select("path", "language", "text").mapInArrow(_batches(0, schema), CHUNK_SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    """Imports of files(path, language, text)."""
    s = pa.string()
    schema = pa.schema([("path", s), ("source", s), ("names", s), ("is_relative", pa.bool_())])
    return files.select("path", "language", "text").mapInArrow(_batches(1, schema), IMPORT_SCHEMA)


def describe(chunks: DataFrame) -> DataFrame:
    """A sentence for each chunk: what it is, where, its parameters and its first doc line."""
    params = F.regexp_extract("content", "\\(([^)]*)\\)", 1)
    doc = F.trim(F.regexp_extract("content", "(?s)(?:\"\"\"|/\\*\\*?|///|#)\\s*([^\\n*]+)", 1))
    text = F.concat_ws(" ", F.col("type"), F.concat(F.lit("'"), "name", F.lit("'")), F.lit("in"), "path", F.when(params != "", F.concat(F.lit("with parameters: "), params)), F.when(doc != "", F.concat(F.lit("- "), doc)))
    return chunks.withColumn("description", text)


_GQL_TYPE = re.compile(r"^\s*(?:extend\s+)?(type|input|interface|enum|scalar|union)\s+(\w+)[^{\n]*(\{)?", re.M)


def graphql_contracts(text: str) -> list[tuple[str, str]]:
    """(symbol, kind) of a schema: types, their fields, and operations of the root types."""
    text = re.sub(r'"""(?:.|\n)*?"""|#.*', "", text)
    out = []
    for m in _GQL_TYPE.finditer(text):
        out.append((m[2], m[1]))
        if m[3]:
            body = text[m.end() : text.find("}", m.end())]
            if m[1] == "enum":
                out += [(f"{m[2]}.{v}", "enum_value") for v in re.findall(r"\b[A-Z_][A-Z0-9_]*\b", body)]
            else:
                kind = "endpoint" if m[2] in ("Query", "Mutation", "Subscription") else "field"
                out += [(f"{m[2]}.{f}", kind) for f in re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*:", re.sub(r"\([^)]*\)", "", body))]
    return out


_GQL_TOKEN = re.compile(r"\.\.\.\s*on\s+\w+|\.\.\.\s*\w*|[{}]|\((?:[^()]|\([^()]*\))*\)|@\w+|(\w+)\s*:|(\w+)")


def graphql_selections(text: str) -> list[tuple[str, str]]:
    """(path, root type) of every field that the operations in gql`...` or graphql(`...`) texts select, as Query.user.name.

    Aliases give way to the fields that they name; fields of inline fragments belong to the field around them;
    fragment definitions and spreads of named fragments are left out.
    """
    out: list[tuple[str, str]] = []
    for m in re.finditer(r"(?:gql|graphql)\s*\(?\s*`((?:.|\n)*?)`", text):
        body = re.sub(r"#.*|\$\{[^}]*\}", "", m[1])
        root, stack, last, skip = None, [], None, False
        for token in _GQL_TOKEN.finditer(body):
            t = token[0]
            if t == "{":
                if not stack:
                    root = root or "Query"
                    stack.append(root)
                else:
                    # an inline fragment opens its parent again
                    stack.append(stack[-1] if last is None else f"{stack[-1]}.{last}")
                last = None
            elif t == "}":
                if stack:
                    stack.pop()
                last = None
                if not stack:
                    root, skip = None, False
            elif t.startswith("..."):
                last = None
            elif token[2] and not stack:
                if t in ("query", "mutation", "subscription"):
                    root = t.capitalize()
                elif t == "fragment":
                    skip = True
            elif token[2]:
                last = t
                if not skip:
                    out.append((f"{stack[-1]}.{t}", root))
    return out


def graphql_uses(text: str) -> list[tuple[str, str]]:
    """(root field, kind) of each operation in gql`...` or graphql(`...`) texts."""
    return [(path, "endpoint") for path, _ in graphql_selections(text) if path.count(".") == 1]
