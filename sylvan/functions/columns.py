"""Column expressions over paths, names and texts, each with its SQL counterpart where one is checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan.functions.terms import STOP_WORDS

TEST_PATH = r"/(test|tests|__tests__|spec|specs|testlib|testing)/"
TEST_NAME = r"^(test_|test\.)|_test\.go$|\.(test|spec)\.(ts|js)$|[._-](test|tests|spec|specs)\.[a-z0-9]+$"
SAMPLE_PATH = r"/(example|examples|sample|samples|fixture|fixtures|mock|mocks)/"
INFRASTRUCTURE = "alloc|free|lock|mutex|stamp"
HEADER_PATH = r"\.(h|hh|hpp|hxx)$|/hdr/|/hdr_|_hdr/"
SKIPPED = (".git", "target", "node_modules", "dist", "build", ".cache")
# -- fixed values: file extension -> language ---------------------------------------------------------
EXTENSIONS = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "pyi": "python", "go": "go", "rs": "rust",
    "sh": "shell", "bash": "shell", "zsh": "shell", "qsc": "esqlc", "sc": "esqlc",
}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def node_id(file_path: Column, kind: Column, name: Column, start_line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file_path, kind, name, start_line.cast("string")), 256), 1, 16)


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(TEST_PATH) | file_name(low).rlike(TEST_NAME)


def is_non_prod(path: Column) -> Column:
    return is_test_file(path) | F.lower(path).rlike(SAMPLE_PATH)


def is_header(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(HEADER_PATH)


def header_preference(path: Column) -> Column:
    """How well a path fits the usual platform, 0 best."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(p.rlike(r"/hdr_unix_win/|_unix_win/|/unix_win/"), 0)
        .when(p.rlike(r"/hdr_unix/|_unix/|/unix/"), 2)
        .when(p.rlike(r"/hdr_win/|_win/|/win/"), 3)
        .when(p.rlike(r"/hdr_vms/|_vms/|/vms/"), 8)
        .when(p.contains("/hdr/"), 1)
        .when(p.rlike(r"/erold|/old"), 9)
        .otherwise(5)
    )


def identifier_parts(name: Column) -> Column:
    """Lower-case parts of an identifier, three letters or longer, without stop words."""
    text = F.regexp_replace(name, r"[_.\-]", " ")
    text = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    text = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(text), r"\s+")
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.filter(parts, lambda p: (F.length(p) >= 3) & ~F.array_contains(stop, p))


def tokens(text: Column) -> Column:
    """Words of a text for full-text search: lower case, split at anything but letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_lines(content: Column) -> Column:
    """Lines of a text; one final newline ends the last line and begins none."""
    body = F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), r"\n\z", "")
    return F.split(body, "\n")


def language_of(path: Column, content: Column | None = None) -> Column:
    """Language by extension; ``sc`` only where the head of the text has embedded SQL."""
    from sylvan.functions.kinds import lookup

    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    found = lookup(EXTENSIONS, ext, None)
    if content is None:
        return F.when(ext != "sc", found)
    return F.when((ext == "sc") & ~F.substring(content, 1, 8192).rlike(r"(?im)^\s*exec sql"), F.lit(None)).otherwise(found)


def skipped_path(path: Column) -> Column:
    """A path with a folder that is never indexed."""
    return F.exists(F.split(path, r"[/\\]"), lambda p: p.isin(*SKIPPED))


def overlap(terms: list[str], *texts: Column) -> Column:
    """How many of the terms stand in any of the texts (lower case)."""
    hay = F.lower(F.concat_ws(" ", *texts))
    total = F.lit(0)
    for t in terms:
        total = total + hay.contains(t).cast("int")
    return total


def file_uri(path: Column) -> Column:
    """A path as a file URI: everything but letters, digits, ``-._~`` and ``/`` escaped."""
    escaped = F.url_encode(path)
    for form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        escaped = F.replace(escaped, F.lit(form), F.lit(wanted))
    return F.concat(F.lit("file://"), escaped)


def uri_path(uri: Column) -> Column:
    """The path of a file URI; null for other URIs and for escapes that are none."""
    bare = F.replace(F.substr(uri, F.lit(8)), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file://"), F.try_url_decode(bare))


def tag_field(text: Column) -> Column:
    """A field of a tags file: backslashes doubled, tabs and line ends as blanks."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "[\t\r\n]", " ")
