"""Code and prose texts: chunks, line scans, references, links, chat mining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.text import any_of
from siftwright.operators.ranking import top_per_group

#: Words before a bracket that are no call.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "class", "and", "or", "not", "in", "is", "new", "typeof", "await", "with", "elif", "print")

#: (name, severity, Java and RE2 pattern) of the line scan.
SECURITY = (
    ("private_key", "critical", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key", "critical", "AKIA[0-9A-Z]{16}"),
    ("api_token", "critical", "(gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|[ps]k_(live|test)_[A-Za-z0-9]{16,}|sk-(ant-)?[A-Za-z0-9_-]{32,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{16,}|SG\\.[A-Za-z0-9_-]{16,})"),
    ("hardcoded_secret", "high", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\s*[:=]\\s*[\"']?[A-Za-z0-9+/_.=-]{8,}"),
    ("command_injection", "critical", "(child_process|exec(Sync|File)?|spawn(Sync)?|system|popen)\\s*\\(\\s*(`[^`]*\\$\\{|f[\"'][^\"']*\\{|[\"'][^\"']*[\"']\\s*\\+)"),
    ("path_traversal", "high", "(read|write|append|unlink|access|create(Read|Write))(File|Stream)?(Sync)?\\s*\\([^)]*(req|params|query|body|input)[.A-Za-z_]*\\s*[+}]"),
    ("eval_call", "high", "(^|[^.A-Za-z0-9_])eval\\s*\\("),
    ("new_function", "high", "new\\s+Function\\s*\\("),
    ("timer_string", "medium", "set(Timeout|Interval)\\s*\\(\\s*[\"'`]"),
    ("shell_true", "high", "shell\\s*=\\s*True"),
    ("sql_template", "high", "(query|execute|raw)\\s*\\(\\s*(f?[\"']|`).*\\$?\\{"),
    ("sql_concat", "medium", "(?i)(select|insert|update|delete)\\s.*[\"']\\s*\\+"),
    ("weak_hash", "medium", "(?i)(^|[^a-z0-9])(md5|sha1)\\("),
    ("debugger", "low", "(^|[^A-Za-z0-9_])debugger\\s*;"),
    ("http_url", "low", "http://[a-z0-9.-]+"),
    ("email_address", "low", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}"),
)

#: Plain text that every match of a pattern holds: looked for first, as a byte search is far cheaper.
HINTS = {
    "private_key": ("PRIVATE KEY-----",), "aws_access_key": ("AKIA",), "eval_call": ("eval",), "new_function": ("Function",), "timer_string": ("setTimeout", "setInterval"), "shell_true": ("shell",), "debugger": ("debugger",), "http_url": ("http://",),
    "email_address": ("@",), "sql_template": ("query", "execute", "raw"), "path_traversal": ("req", "params", "query", "body", "input"), "command_injection": ("child_process", "exec", "spawn", "system", "popen"), "console_log": ("console",),
}

#: What is found in test files too: secrets that leak from them as well.
LEAKS = ("private_key", "aws_access_key", "api_token")
#: A hardcoded secret's line with one of these is a sample, a rule or a look-up, not a secret.
PLACEHOLDER = "(?i)([:=]\\s*[\"']?(changeme|password|your[-_]|example|placeholder|xxx|test|dummy|todo)|must be|should be|at least|characters|required|process\\.env|import\\.meta\\.env|os\\.environ|getenv)"
#: A file that logs more often than this is told of each place.
LOG_CALLS = 10


def chunk_windows(docs: DataFrame, id_col: str, text: Column, size: int = 50) -> DataFrame:
    """(id, chunk, start_line, end_line, content): blocks of ``size`` lines, cut within the row."""
    lines = docs.select(F.col(id_col).alias("id"), F.split(text, "\n").alias("ls"))
    starts = F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / size).cast("int"))
    each = lines.select("id", "ls", F.explode(starts).alias("chunk"))
    start = F.col("chunk") * size
    return each.select("id", "chunk", (start + 1).alias("start_line"), F.least(start + size, F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", start + 1, size), "\n").alias("content"))


def lines(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, line, content), lines counting from 1."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "content")).select("id", (F.col("pos") + 1).alias("line"), "content")


def security_scan(docs: DataFrame, id_col: str, text: Column, patterns=SECURITY, path: Column | None = None) -> DataFrame:
    """(id, line, pattern, severity): one pass over the lines that any pattern hits; comment lines are skipped.

    With ``path``, vendored files are left out, test files are searched for leaked secrets only, and files that
    are neither tests nor command lines and call console.log more than LOG_CALLS times have each call listed.
    """
    hit = lambda c, n, p: any_of(c, HINTS[n]) & c.rlike(p) if n in HINTS else c.rlike(p)
    if path is not None:
        from siftwright.operators.audit import PATH_CLASSES

        docs = docs.where(~path.rlike(PATH_CLASSES["vendored"]))
        patterns = (*patterns, ("console_log", "low", "console\\.log\\s*\\("))
    place = F.struct(F.col(id_col).alias("id"), *([] if path is None else [path.alias("path")]))
    # what a text holds at all, once; its lines are then held against those patterns only
    marked = docs.select(place.alias("id"), text.alias("text"), F.array(*(F.coalesce(hit(text, n, p), F.lit(False)) for n, _, p in patterns)).alias("some"))
    split = F.when(F.array_contains("some", True), F.split("text", "\n"))
    rows = marked.select("id", "some", F.posexplode(split).alias("pos", "content")).select("id", "some", (F.col("pos") + 1).alias("line"), "content").where(~F.col("content").rlike("^\\s*(//|#|\\*)"))
    sample = F.col("content").rlike(PLACEHOLDER)
    good = lambda i, n, p: F.get("some", F.lit(i)) & (hit(F.col("content"), n, p) & ~sample if n == "hardcoded_secret" else hit(F.col("content"), n, p))
    hits = F.filter(F.array(*(F.when(good(i, n, p), F.struct(F.lit(n).alias("pattern"), F.lit(s).alias("severity"))) for i, (n, s, p) in enumerate(patterns))), lambda x: x.isNotNull())
    found = rows.select("id.*", "line", F.explode(hits).alias("h")).select("*", "h.pattern", "h.severity").drop("h")
    if path is None:
        return found
    test = F.col("path").rlike(PATH_CLASSES["test"])
    found = found.where(~test | F.col("pattern").isin(*LEAKS)).where((F.col("pattern") != "console_log") | ~F.col("path").rlike(PATH_CLASSES["cli"]))
    many = found.where("pattern = 'console_log'").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > LOG_CALLS).select("id", F.lit("console_log").alias("pattern"))
    noisy = found.where("pattern = 'console_log'").join(many, ["id", "pattern"], "left_semi")
    return found.where("pattern <> 'console_log'").unionByName(noisy).drop("path")


#: Forms in which a line refers to a name, group 1 being the name: calls, constructors, JSX elements, arguments, decorators, types.
REFERENCES = (
    "([A-Za-z_][A-Za-z0-9_]{2,})\\s*\\(",
    "(?:^|[^A-Za-z0-9_])new\\s+([A-Z][A-Za-z0-9_]{2,})",
    "<([A-Z][A-Za-z0-9_]{2,})",
    "[,(]\\s*([a-z_][A-Za-z0-9_]{2,})\\s*[,)]",
    "@([A-Z][A-Za-z0-9_]{2,})",
    "(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]{2,})(?:<|\\[\\]|\\.class|\\s+[a-z_])",
    "(?:extends|implements|throws|instanceof|catch)[\\s(]+([A-Z][A-Za-z0-9_]{2,})",
    "[<,]\\s*([A-Z][A-Za-z0-9_]{2,})\\s*[>,?&]",
    "import\\s+(?:static\\s+)?(?:[a-z_][A-Za-z0-9_]*\\.)+([A-Z][A-Za-z0-9_]{2,})",
)
#: Names that say nothing wherever they stand.
COMMON_NAMES = (
    *("abstract", "await", "break", "case", "class", "const", "continue", "crate", "def", "default", "defn", "echo", "elif", "else", "end", "enum", "except", "export", "extends", "extern", "false", "final", "finally", "func"),
    *("impl", "implements", "import", "include", "interface", "let", "match", "mod", "module", "mut", "namespace", "nil", "null", "object", "package", "private", "protected", "pub", "public", "raise", "record", "ref", "require", "self", "static", "struct", "super"),
    *("then", "this", "throw", "throws", "trait", "true", "try", "type", "undefined", "unsafe", "use", "var", "void", "when", "yield", "console", "process", "Array", "Object", "String", "Number", "Boolean", "Map", "Set", "Promise", "Error", "Date", "Math", "JSON", "RegExp"),
    *("Integer", "Long", "Double", "Float", "List", "ArrayList", "HashMap", "HashSet", "Optional", "Stream", "Exception", "RuntimeException", "Override", "Deprecated", "length", "push", "pop", "shift", "unshift", "map", "filter", "reduce", "forEach", "slice", "splice", "split", "join", "concat", "includes", "indexOf", "find", "some", "every"),
    *("log", "info", "warn", "error", "debug", "println", "printf", "assert", "expect", "test", "describe", "beforeEach", "afterEach", "parseInt", "parseFloat", "toString", "valueOf"),
)


def call_references(docs: DataFrame, id_col: str, text: Column, skip_definitions: bool = False) -> DataFrame:
    """(id, line, name): names that a line refers to in any form of REFERENCES, once a line; strings and comments are taken out before.

    The name that a line defines as a class, interface, enum or record is no reference; with
    ``skip_definitions``, neither is that of a function.
    """
    code = F.regexp_replace(F.regexp_replace(F.col("content"), "\"[^\"]*\"|'[^']*'|`[^`]*`", ""), "//.*|#.*|--.*", "")
    code = F.regexp_replace(code, "(^|[^A-Za-z0-9_])(class|interface|enum|record)\\s+[A-Za-z_][A-Za-z0-9_]*", "")
    if skip_definitions:
        code = F.regexp_replace(code, "(^|[^A-Za-z0-9_])(def|function|func|fn|fun|sub)\\s+[A-Za-z_][A-Za-z0-9_]*", "")
    rows = lines(docs, id_col, text).where(F.col("content").rlike("[(<@,]|[A-Z]")).select("id", "line", code.alias("code"))
    names = reduce(F.array_union, (F.regexp_extract_all("code", F.lit(p), F.lit(1)) for p in REFERENCES))
    each = rows.select("id", "line", F.explode(names).alias("name"))
    return each.where(~F.col("name").isin(*NOT_CALLS, *COMMON_NAMES))


def doc_mentions(docs: DataFrame, id_col: str, text: Column, known: DataFrame) -> DataFrame:
    """(id, symbol, confidence): names in backticks 1.0, in fences 0.8, bare 0.5 where two known ones share a paragraph.

    known(symbol) of at least three letters.
    """
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    fences = F.regexp_extract_all("text", F.lit("(?s)```(.*?)```"), F.lit(1))
    plain = F.regexp_replace("text", "(?s)```.*?```", "\n\n")
    ticked = rows.select("id", F.explode(F.regexp_extract_all(plain, F.lit("`([A-Za-z_][A-Za-z0-9_.]*)`"), F.lit(1))).alias("symbol"), F.lit(1.0).alias("confidence"))
    word = F.lit("([A-Za-z_][A-Za-z0-9_]+)")
    fenced = rows.select("id", F.explode(fences).alias("code")).select("id", F.explode(F.array_distinct(F.regexp_extract_all("code", word, F.lit(1)))).alias("symbol"), F.lit(0.8).alias("confidence"))
    paragraphs = rows.select("id", F.posexplode(F.split(F.regexp_replace(plain, "`[^`]*`", " "), "\n\\s*\n")).alias("p", "body"))
    bare = paragraphs.select("id", "p", F.explode(F.array_distinct(F.regexp_extract_all("body", word, F.lit(1)))).alias("symbol"))
    names = known.select("symbol").where(F.length("symbol") >= 3).distinct()
    bare = bare.join(names, "symbol", "left_semi")
    several = bare.groupBy("id", "p").agg(F.count("*").alias("n")).where("n >= 2")
    bare = bare.join(several, ["id", "p"], "left_semi").select("id", "symbol", F.lit(0.5).alias("confidence"))
    found = ticked.unionByName(fenced).join(names, "symbol", "left_semi").select("id", "symbol", "confidence").unionByName(bare)
    return found.groupBy("id", "symbol").agg(F.max("confidence").alias("confidence"))


def link_symbols(mentions: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, symbol, target): the definition of best kind, then best rank. definitions(symbol, target, kind, rank)."""
    kind = F.when(F.col("kind").isin("class", "interface"), 5).when(F.col("kind") == "function", 4).when(F.col("kind") == "method", 3).when(F.col("kind") == "type", 2).otherwise(1)
    return mentions.join(definitions, "symbol").groupBy("id", "symbol").agg(F.max_by("target", F.struct(kind.alias("k"), "rank", "target")).alias("target"))


def mine_chat(messages: DataFrame, conv: str, turn: str, role: str, text: str, wanted: dict[str, str], skip: str, last: int = 100, cap: int = 50) -> DataFrame:
    """Statements worth keeping from the last messages of each conversation.

    ``wanted`` maps a role to its pattern. Of equal statements (case and blanks aside) the surest, then shortest,
    then earliest stays; the ``cap`` surest are returned.
    """
    recent = top_per_group(messages, [conv], [F.col(turn).desc()], last).drop("rank")
    match = reduce(lambda a, b: a | b, ((F.col(role) == r) & F.col(text).rlike(p) for r, p in wanted.items()))
    newlines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    kept = recent.where(match & F.length(text).between(30, 4000) & (newlines <= 30) & ~F.col(text).rlike(skip))
    kept = kept.withColumn("confidence", F.when(F.col(role) == "user", 0.7).otherwise(0.6)).withColumn("key", F.lower(F.trim(text)))
    order = F.struct((-F.col("confidence")).alias("a"), F.length(text).alias("b"), F.col(conv).alias("c"), F.col(turn).alias("d"))
    best = kept.groupBy("key").agg(F.min_by(F.struct(conv, turn, role, "confidence", F.length(text).alias("n_chars")), order).alias("r")).select("r.*")
    return best.orderBy(F.col("confidence").desc(), "n_chars", conv, turn).limit(cap)


def git_log_memories(log: DataFrame, subject: str) -> DataFrame:
    """Conventional commit subjects as memories: feat, fix, refactor are decisions; perf, chore are context."""
    parts = log.withColumn("type", F.regexp_extract(subject, "^(feat|fix|refactor|perf|chore)(\\([^)]*\\))?!?:", 1)).withColumn("content", F.regexp_replace(subject, "^[a-z]+(\\([^)]*\\))?!?:\\s*", ""))
    category = F.when(F.col("type").isin("feat", "fix", "refactor"), "decision").otherwise("context")
    return parts.where((F.col("type") != "") & F.length("content").between(20, 500)).withColumn("category", category)


def diff_lines(diff: DataFrame, text: str, of: str | None = None) -> DataFrame:
    """(file, old_start, new_start, op, content) of unified diffs whose lines are numbered in ``line``.

    ``of`` names the diff that a line belongs to, so that many diffs are read side by side; one diff is read in one task.
    """
    order = Window.partitionBy(*([of] if of else [F.lit(0)])).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last_value(c, True).over(order)
    head = F.when(F.col(text).startswith("@@"), F.struct(F.regexp_extract(text, "^@@ -(\\d+)", 1).cast("int").alias("old_start"), F.regexp_extract(text, "\\+(\\d+)", 1).cast("int").alias("new_start")))
    file = F.when(F.col(text).startswith("+++ "), F.regexp_replace(text, "^\\+\\+\\+ (b/)?", ""))
    rows = diff.withColumn("file", last(file)).withColumn("head", last(head))
    body = F.col(text).rlike("^[ +-]") & ~F.col(text).rlike("^(\\+\\+\\+|---) ")
    return rows.where(body & F.col("head").isNotNull()).select(*([of] if of else []), "file", "head.old_start", "head.new_start", F.substring(text, 1, 1).alias("op"), F.substring(text, 2, 1 << 30).alias("content"))


def change_status(names: DataFrame, line: str) -> DataFrame:
    """(path, status) of name-status lines: A and C added, M modified, D deleted, R renamed with its old path."""
    cols = F.split(line, "\t")
    code = F.substring(F.get(cols, F.lit(0)), 1, 1)
    status = F.when(code.isin("A", "C"), "added").when(code == "M", "modified").when(code == "D", "deleted").when(code == "R", "renamed")
    path = F.when(code.isin("R", "C"), F.get(cols, F.lit(2))).otherwise(F.get(cols, F.lit(1)))
    return names.select(path.alias("path"), status.alias("status"), F.when(code == "R", F.get(cols, F.lit(1))).alias("old_path")).where("status IS NOT NULL AND path IS NOT NULL")


def grep_blocks(text: DataFrame, col: str, pattern: str, head: int | None = None) -> DataFrame:
    """Blocks that start at '## ' and match a pattern; an unsafe or over-long pattern is taken literally."""
    import re

    if len(pattern) > 256 or re.search(r"\([^)]*[+*]\)[+*]", pattern):
        pattern = re.escape(pattern)
    blocks = text.select(F.posexplode(F.split(col, "\\n(?=## )")).alias("i", "block")).where(F.col("block").startswith("## ") & F.col("block").rlike(pattern))
    return blocks if head is None else blocks.orderBy("i").limit(head)
