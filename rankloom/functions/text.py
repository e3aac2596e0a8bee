"""Column expressions over texts, paths, URLs and patches; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of files that are no text, suffixes of source code, parts of paths that hold no product code,
# the first words of subjects of little value, and the names of trailer lines.
BINARY_SUFFIXES = (
    "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "whl", "jar", "class", "so", "dylib", "dll", "exe", "bin", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "webm", "ogg", "pyc", "wasm", "onnx", "pt", "pack",
    "idx", "parquet", "npy", "npz", "h5", "proto3", "lock",
)
CODE_SUFFIXES = ("c", "cc", "cpp", "cs", "go", "h", "hpp", "java", "js", "jsx", "kt", "kts", "php", "py", "pyi", "rb", "rs", "scala", "sh", "swift", "ts", "tsx")
NOISE_PARTS = (".github", "benchmark", "benchmarks", "dist", "docs", "examples", "fixtures", "generated", "node_modules", "snapshot", "snapshots", "vendor")
LOW_VALUE = r"(?i)^(build|bump|chore|ci|docs?|format|lint|release|style|tests?)(\([^)]*\))?[!: ]"
TRAILER = r"(?i)^(change-id|co-authored-by|reviewed-by|signed-off-by):"


#: A run of letters, digits and underscores.
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^ \t\n\x0B\f\r]+)"), F.lit(1))), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def _behind(text: Column, mark: Column) -> Column:
    """What is behind the first mark in a text, or the text if there is none."""
    at = F.position(mark, text)
    return F.when(at > 0, F.substring(text, at + F.length(mark), F.length(text))).otherwise(text)


def _inner(path: Column) -> Column:
    """A path with slashes, cut at a fragment or query, without one leading `./` and leading slashes."""
    out = F.regexp_replace(F.translate(path, "\\", "/"), "(?s)[#?].*$", "")
    return F.ltrim(F.regexp_replace(out, r"^\./", ""), F.lit("/"))


def _without(path: Column, prefix: Column) -> Column:
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def _unquoted(path: Column) -> Column:
    return F.regexp_replace(strip(path), "^[\"'`]+|[\"'`]+$", "")


def normal_path(path: Column, repo: Column | None = None) -> Column:
    """A path inside its repository; null for null and for what leaves nothing.

    Quotes, back slashes, fragment, query, one leading `./`, leading slashes and the repository's name go, and all up to the
    folder below `/arb/<repository>/`.
    """
    out = _inner(_unquoted(path))
    if repo is not None:
        out = _without(out, F.concat(repo, F.lit("/")))
        mark = F.concat(F.lit("/arb/"), repo, F.lit("/"))
        out = F.when(F.contains(out, mark), F.regexp_replace(_behind(out, mark), "(?s)^[^/]*/", "")).otherwise(out)
    return _filled(out)


def path_of_url(url: Column, repo: Column | None = None, revision: Column | None = None) -> Column:
    """The repository path in a URL, percent-decoded before it is cut; other values as paths; null where nothing is left.

    Of a URL the part behind `/<repository>/blob/<revision>/` is taken, else that behind the revision after `/blob/`, else all
    behind the host.  A value with a broken percent sign is not decoded.
    """
    out = _unquoted(url)
    out = F.translate(F.coalesce(F.try_url_decode(F.replace(out, F.lit("+"), F.lit("%2B"))), out), "\\", "/")
    host = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
    inside = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, host, ""), "(?s)[#?].*$", ""), "(?s);[^/]*$", "")
    blob = F.when(F.contains(inside, F.lit("/blob/")), F.regexp_replace(_behind(inside, F.lit("/blob/")), "(?s)^[^/]*/", "")).otherwise(inside)
    if repo is not None and revision is not None:
        own = F.concat(F.lit("/"), repo, F.lit("/blob/"), revision, F.lit("/"))
        blob = F.when(F.startswith(inside, own), _without(inside, own)).otherwise(blob)
    out = _inner(F.when(out.rlike(host), blob).otherwise(out))
    return _filled(out if repo is None else _without(out, F.concat(repo, F.lit("/"))))


def normal_url(url: Column) -> Column:
    """A URL without closing punctuation, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[.,;:]+$", ""), "#.*$", ""), "/+$", "")


def urls(text: Column) -> Column:
    """The distinct normalised URLs of a text, in order; white space, closing brackets, quotes and `>` end one."""
    found = F.regexp_extract_all(text, F.lit(r"""(https?://[^\s)\]"'>]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, normal_url))


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, or an empty string; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_text_candidate(path: Column) -> Column:
    return ~suffix(path).isin(*BINARY_SUFFIXES)


def is_source_path(path: Column) -> Column:
    """Whether a path has a suffix of source code and no part that holds no product code."""
    normal = F.translate(strip(path), "\\", "/")
    return suffix(normal).isin(*CODE_SUFFIXES) & ~F.arrays_overlap(F.split(F.lower(normal), "/"), F.array(*map(F.lit, NOISE_PARTS)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_kind(path: Column) -> Column:
    """test, docs, python_source or other: by `test` anywhere, then by the end of the path."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("test")), "test").when(low.rlike(r"\.(rst|md|txt)$"), "docs").when(F.endswith(low, F.lit(".py")), "python_source").otherwise("other")


def parent_directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def clean_message(message: Column, most: int = 4000) -> Column:
    """A commit message without trailer lines, its lines without white space behind them, stripped, cut and stripped again."""
    lines = F.filter(F.split(message, "\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: ~strip(x).rlike(TRAILER))
    kept = strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))
    return strip(F.substring(kept, 1, most))


def is_low_value(subject: Column) -> Column:
    return subject.rlike(LOW_VALUE)


def leaks(query: Column, paths: Column) -> Column:
    """Whether a query names one of the paths or one of their base names."""
    low = F.lower(query)
    return F.exists(paths, lambda p: F.contains(low, F.lower(p)) | F.contains(low, F.lower(base_name(p))))


def patch_files(patch: Column) -> Column:
    """The distinct new-side files of a git patch, in order; paths without white space."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?md)^diff --git a/\S+ b/(\S+)$"), F.lit(1)))


def patch_hunks(patch: Column) -> Column:
    """(path, first line, last line) of each hunk, on the old side: the old file, or the new one where there is no old one.

    A length of 0 counts as one line.  A hunk belongs to the last file line before it; a line `+++` counts only behind
    `--- /dev/null`, and hunks before any file line are left out.
    """
    number = lambda text, pattern: F.try_to_number(_filled(F.regexp_extract(text, pattern, 1)), F.lit("9" * 18)).cast("int")
    own = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
    none = F.lit(None).cast("string")

    def step(at: Column, line: Column) -> Column:
        target = strip(F.substring(line, 5, 1 << 30))
        old = F.when(target == "/dev/null", none).otherwise(_without(target, F.lit("a/")))
        path = F.when(F.startswith(line, F.lit("--- ")), old).when(F.startswith(line, F.lit("+++ ")) & at["path"].isNull(), _without(target, F.lit("b/"))).otherwise(at["path"])
        first = number(line, own)
        size = F.greatest(F.coalesce(number(line, own.replace(r"-(\d+)(?:,(\d+))?", r"-\d+(?:,(\d+))?")), F.lit(1)), F.lit(1))
        hunk = F.array(F.struct(path.alias("path"), first.alias("first"), (first + size - 1).alias("last")))
        return F.struct(path.alias("path"), F.when(line.rlike(own) & path.isNotNull(), F.concat(at["hunks"], hunk)).otherwise(at["hunks"]).alias("hunks"))

    lines = F.filter(F.split(patch, "\r\n|\n|\r"), lambda x: x.rlike("^(---|\\+\\+\\+|@@)"))
    start = F.struct(none.alias("path"), F.array().cast("array<struct<path:string,first:int,last:int>>").alias("hunks"))
    return F.aggregate(lines, start, step)["hunks"]


def sections(text: Column) -> Column:
    """(path, first line, last line) of `### path (lines a-b)` and `### path` headings; no lines for the latter.

    Only what is behind the first `<retrieved_context>` counts, if there is one; of a path's headings the last gives the lines.
    """
    heads = F.regexp_extract_all(_behind(text, F.lit("<retrieved_context>")), F.lit(r"(?md)^(### \S+(?: \(lines \d+-\d+\))?)$"), F.lit(1))
    line = lambda head, pattern: _filled(F.regexp_extract(head, pattern, 1)).cast("int")
    found = F.transform(heads, lambda h: F.struct(F.regexp_extract(h, r"^### (\S+)", 1).alias("path"), line(h, r"lines (\d+)-").alias("first"), line(h, r"-(\d+)\)$").alias("last")))
    return F.transform(F.array_distinct(F.transform(found, lambda x: x["path"])), lambda path: F.element_at(F.filter(found, lambda x: x["path"] == path), -1))


def compact_query(prompt: Column, most: int = 2000, least_words: int = 4) -> Column:
    """The prose lines of a prompt before its answer mark, joined and cut; the prompt's beginning if none is left."""
    problem = F.get(F.split(prompt, r"\n\s*A:\s*\n"), F.lit(0))
    lines = F.transform(F.split(problem, "\n"), lambda x: F.regexp_replace(strip(x), r"[ \t\r\n]+", " "))
    marks = lambda x: F.length(x) - F.length(F.translate(x, "{}[]()='\":,", ""))
    prose = F.filter(
        lines,
        lambda x: (x != "")
        & ~F.lower(x).rlike(r"^(problem:$|>>>|\.\.\.|import |from |<code>|</code>|begin solution|result =)")
        & (F.size(F.regexp_extract_all(x, F.lit(r"([A-Za-z][A-Za-z0-9_.-]*)"), F.lit(1))) >= least_words)
        & (marks(x) <= F.greatest(F.lit(8), F.floor(F.length(x) / 7).cast("int")))
        & ~x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*="),
    )
    return F.coalesce(F.nullif(F.substring(F.array_join(prose, " "), 1, most), F.lit("")), F.substring(prompt, 1, most))


def identifier_weight(term: Column) -> Column:
    """1.2 for dotted names, 1.0 for names with an underscore or inner or only capitals, else 0.5."""
    capitals = term.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") | term.rlike(r"^.+\p{Lu}")
    return F.when(F.contains(term, F.lit(".")), 1.2).when(F.contains(term, F.lit("_")) | capitals, 1.0).otherwise(0.5)


def identifier_hit(context: Column, identifiers: Column) -> Column:
    """Whether the context contains one of the identifiers, whatever the case."""
    low = F.lower(context)
    return F.exists(identifiers, lambda x: F.contains(low, F.lower(x)))


#: Marks before and behind the code of a reply (fixed values).
CODE_STARTS = ("BEGIN SOLUTION\n<code>", "# SOLUTION START", "\n<code>")
CODE_ENDS = ("</code>", "# SOLUTION END")
_SOURCE = "metadata struct<file_path string, sourceURL string, source_url string, start_line string, end_line string>"


def item_identity(raw_id: Column, path: Column, rest: Column) -> Column:
    """What an item is known by: its raw id, else its path, else its other fields (a map of strings) as JSON in the order of their names.

    A raw id that is an object with metadata of a file or source is `path:start:end`.  Fields rank and score don't count.
    """
    raw = F.coalesce(_filled(raw_id), path, F.lit(""))
    source = F.from_json(F.when(F.startswith(raw, F.lit("{")), raw), _SOURCE)["metadata"]
    file = F.coalesce(*(_filled(source[c]) for c in ("file_path", "sourceURL", "source_url")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    fields = F.array_sort(F.map_entries(F.map_filter(rest, lambda k, v: ~k.isin("rank", "score"))))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(quoted(e["value"])))), ", "), F.lit("}"))
    part = lambda c: F.coalesce(source[c], F.lit(""))
    return F.when(file.isNotNull(), F.concat_ws(":", file, part("start_line"), part("end_line"))).when(raw != "", raw).otherwise(whole)


def generated_code(reply: Column) -> Column:
    """The code of a reply: its first fenced block, or all of it, between the marks of a solution, stripped."""
    fence = r"(?s)```(?:python)?\s*(.*?)```"
    out = F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply)
    for mark in CODE_STARTS:
        out = _behind(out, F.lit(mark))
    for mark in CODE_ENDS:
        out = F.substring_index(out, mark, 1)
    return strip(out)


def selected_ids(reply: Column, valid: Column, most: int) -> Column:
    """The first distinct valid `E123` identifiers of a reply, each a word of its own."""
    found = F.array_distinct(F.regexp_extract_all(reply, F.lit(r"(?<![\p{L}\p{N}_])(E[0-9]{3,6})(?![\p{L}\p{N}_])"), F.lit(1)))
    return F.slice(F.array_intersect(found, valid), 1, most)


def gold_target(explicit: Column, task: Column, cause: Column, tests: Column) -> Column:
    """The first non-empty of explicit, task, cause and test files, or an empty array."""
    filled = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(filled(explicit), filled(task), filled(cause), filled(tests), F.array().cast("array<string>"))


def is_prose(query: Column, least_words: int = 6) -> Column:
    """Whether a query reads like prose: enough plain words, and at most one mark of code for each eight characters."""
    words = F.size(F.regexp_extract_all(query, F.lit(r"(\p{L}{2,})"), F.lit(1)))
    marks = F.length(query) - F.length(F.translate(query, "{}[]()=<>;_", ""))
    return (words >= least_words) & (marks * 8 <= F.length(query))


def expanded(query: Column, expansion: Column) -> Column:
    """The dense query: with its expansion if it is prose and there is one."""
    return F.when(is_prose(query) & expansion.isNotNull(), F.concat_ws(" ", query, expansion)).otherwise(query)
