"""What one file tells about who wrote it: its path, its head, its names and its layout."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# -- fixed values: places and names tools and package managers use ---------------------------------
GENERATED_DIRS = frozenset("generated __generated__ _generated autogen autogenerated gen generated-src generated_src generated-sources codegen-out".split())
GENERATED_PARTS = frozenset("generated codegen autogen gen g pb pb2 designer swagger".split())
GENERATED_ENDS = frozenset("generated autogen autogenerated gen pb pb2 grpc".split())
GENERATED_STARTS = ("moc_", "qrc_", "ui_mainwindow", "zz_generated", "generated_", "autogen_")
VENDOR_DIRS = frozenset(
    "vendor _vendor vendored vendors third_party third-party thirdparty 3rdparty 3rd_party 3rd-party node_modules bower_components jspm_packages site-packages dist-packages".split()
)
#: names that projects also use for code of their own, so a package folder must follow
VENDOR_IF_PACKAGE = frozenset("external externals extern deps upstream contrib pods carthage".split())
#: what people generate by hand-written code: ``code_gen`` is a generator, not its output
GENERATORS = frozenset("code shader test data key id name doc docs number random".split())
TOOL_NOTICE = re.compile(
    r"@generated\b(?! by hand)|@autogenerated|<auto-?generated|\bauto-?\s?generated (?:by|from|using|with|file)|\bautomatically generated (?:by|from|using|with)|"
    r"\b(?:code|file|source|this)\b.{0,40}\bgenerated (?:automatically )?(?:by|from|using|with(?! (?:love|care|pride|the|our|a|an|help)\b))\b|\bgenerated by\b.{0,60}\b(?:do not|don'?t) (?:edit|modify)|^\W*generated (?:by|from|with) \S+|"
    r"\bdo not (?:edit|modify|change)(?: this file)?(?: by hand| manually| directly)?\W*$|"
    r"(?:this file|file|code) (?:was|is|has been) (?:created|produced|written|built|emitted|made) (?:automatically|by a tool|by a script|by \S+ from)|"
    r"\bmanual (?:changes|edits|modifications) (?:will|may|would) be (?:lost|overwritten)|\b(?:changes|edits) (?:made here |to this file )?will be (?:lost|overwritten)|"
    r"^\W*(?:produced|created|built|compiled|emitted|written) by \S+(?: [\d.v]+)? from \S+|\bedit the (?:schema|source|template|grammar|definition|spec)\w* instead|"
    r"automatisch (?:erzeugt|generiert|erstellt)|nicht von hand (?:bearbeiten|ändern)|(?:fichier|code) (?:produit|généré|créé)(?: automatiquement)? par|ne pas (?:modifier|éditer)|"
    r"(?:archivo|fichero|código) (?:generado|producido|creado)(?: automáticamente)? por|generado automáticamente|no (?:editar|modificar)\W*$|"
    r"(?:файл|код) (?:создан|сгенерирован)(?: автоматически)?|сгенерировано|не (?:редактировать|изменять)(?: вручную)?",
    re.I | re.M,
)
COPY_NOTICE = re.compile(
    r"^\W*(?:upstream|verbatim|vendored|unmodified|local|bundled|embedded|imported|third-?party) copy of\b|\bsend (?:fixes|patches|bugs|changes|issues) (?:to|upstream)\b.{0,60}\bnot here|"
    r"^\W*this file is part of (?!this\b|the project\b)\S+.{0,40}\b(?:release|version|v?\d+\.\d)|"
    r"^\W*\S+ v?\d+(?:\.\d+)+\s*(?:[-–|*]\s*)?(?:\(?https?://\S+|.{0,30}distributed under)|\bdistributed under its own (?:terms|licen[sc]e)|"
    r"^\W*vendored from\b|^\W*(?:copied|taken|imported|borrowed) (?:verbatim |unmodified )?from (?:https?://|\S+ v?\d+\.\d)|^\W*/?\*?!\s*\S+ v\d+\.\d+",
    re.I | re.M,
)
NUMBER_OR_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?<![\w.])[-+]?(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\w)")
BLOCKS = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.S)
SLASHES = re.compile(r"//[^\n]*")
HASHES = re.compile(r"(?m)^[ \t]*#(?!\s*(?:include|define|pragma|if|endif|else|undef))[^\n]*")
NAME = re.compile(r"[^\W\d]\w*")
WORDY = re.compile(r"\b(?:function|return|var|let|const|if|for|while|class|import|export|def|fn|func|int|void|struct|package|use)\b")
PASCAL, CAMEL = re.compile(r"[A-Z][a-z]+[A-Z]"), re.compile(r"[a-z]+[A-Z]")
DIGITS = re.compile(r"\d+")
ODD = re.compile(r"[\x00-\x08\x0e-\x1f\ufffd]")
_KEEP = "abcdefghijklmnopqrstuvwxyz0123456789_"
OTHER, START, END = len(_KEEP), len(_KEEP) + 1, len(_KEEP) + 2
ALPHABET = len(_KEEP) + 3
_CODE = np.full(128, OTHER, np.int64)
_CODE[[ord(c) for c in _KEEP]] = np.arange(len(_KEEP))
_CODE[ord("^")], _CODE[ord("$")] = START, END


def path_evidence(path: str) -> str:
    parts = [p for p in re.split(r"[/\\]+", path) if p]
    if not parts:
        return ""
    folders, base = [p.lower() for p in parts[:-1]], parts[-1].lower()
    if any(f in GENERATED_DIRS for f in folders):
        return "generated path"
    pieces = base.split(".")
    stem = pieces[0]
    if len(pieces) > 2 and any(p in GENERATED_PARTS for p in pieces[1:-1]):
        return "generated name"
    if len(pieces) > 2 and pieces[-1] in ("c", "cc", "cpp", "h", "hpp", "cxx") and pieces[-2] == "tab":
        return "generated name"
    if base.startswith("lex.yy.") or len(pieces) > 2 and pieces[0] == "lex" and pieces[1].startswith("yy"):
        return "generated name"
    words = re.split(r"[_-]", stem)
    if base.startswith(GENERATED_STARTS) or len(words) > 1 and words[-1] in GENERATED_ENDS and words[-2] not in GENERATORS:
        return "generated name"
    for i, f in enumerate(folders[1:], 1):
        if f in VENDOR_DIRS:
            return "vendor path"
        if f in VENDOR_IF_PACKAGE and i + 1 < len(folders) and (f != "contrib" or folders[i + 1] in VENDOR_DIRS | VENDOR_IF_PACKAGE):
            return "vendor path"
    return ""


#: lines that may stand above a notice without being code of the file's own
PREAMBLE = re.compile(r"package\b|import\b|from\s+\S+\s+import\b|#\s*(?:include|pragma|ifndef|define)\b|use\s+\S+;|extern crate\b|mod\s+\w+;|['\"]use strict['\"]|require\b|(?:const|var|let)\s+\S+\s*=\s*require\(|[)(]|\"[^\"]*\"$")
COMMENT = re.compile(r"(?://+!?|#+(?!include|define|pragma|if|ifdef|ifndef|endif|undef|import)(?=\s|$|@)|--|;+|%+)\s*(.*)$")


def head_comments(content: str, language: str) -> list[str]:
    """Comment lines before the first line of the file's own code, markers removed: packages, imports and
    includes may stand before them."""
    out, end, at = [], len(content), 0
    while at < end:
        stop = content.find("\n", at)
        stop = end if stop < 0 else stop
        s = content[at:stop].strip()
        at = stop + 1
        if not s or s.startswith("#!"):
            continue
        mark = next((q for q in ("/*", '"""', "'''") if s.startswith(q)), None)
        if mark == "/*" or mark and language == "python":
            close = "*/" if mark == "/*" else mark
            begin = content.index(mark, content.rfind("\n", 0, stop) + 1)
            over = content.find(close, begin + len(mark))
            over = end if over < 0 else over
            out += [row.strip("*! \t\r") for row in content[begin + len(mark) : over].split("\n")]
            at = content.find("\n", over)
            at = end if at < 0 else at + 1
            continue
        m = COMMENT.match(s)
        if m:
            out.append(m[1].strip())
        elif not PREAMBLE.match(s):
            break
    return out


def head_evidence(lines: list[str]) -> str:
    for line in lines:
        if TOOL_NOTICE.search(line):
            return "tool notice"
        if COPY_NOTICE.search(line):
            return "copy notice"
    return ""


def gram_counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the names as numbers below ``ALPHABET`` cubed, and how often each comes. A name stands
    between two start marks and an end mark; case is folded, letters beyond a-z are one character."""
    if not names:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = "^^" + "$^^".join(names).lower() + "$"
    codes = _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]
    inside = (codes[:-2] != END) & (codes[1:-1] != END)
    ids = (codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:]
    found, times = np.unique(ids[inside], return_counts=True)
    return found.astype(np.int32), times.astype(np.int32)


def features(content: str, language: str) -> dict:
    """Names (each once), literal share, layout."""
    code = BLOCKS.sub(" ", content)
    code = HASHES.sub("", code) if language in ("python", "shell") else SLASHES.sub("", code)
    parts = NUMBER_OR_STRING.split(code)
    literal_chars = len(code) - sum(map(len, parts))
    rest = " ".join(parts)
    lines = content.split("\n")
    solid = max(1, len("".join(code.split())))
    return {
        "names": [n for n in dict.fromkeys(NAME.findall(rest)) if "$" not in n],
        "literal_chars": literal_chars,
        "literal_share": literal_chars / solid,
        "longest": max(map(len, lines)),
        "per_line": len(content) / max(1, sum(1 for x in lines if x and not x.isspace())),
        "blank_share": 1 - len("".join(content.split())) / max(1, len(content)),
        "odd_share": len(ODD.findall(content)) / max(1, len(content)),
        "wordy": len(set(WORDY.findall(rest))),
    }


def template_diversity(names: list[str]) -> float:
    """Different names after their digits are folded, as a share of all names: low where a template made them."""
    if not names:
        return 1.0
    return len({DIGITS.sub("0", n) for n in names}) / len(names)


def bits(weights: np.ndarray) -> np.ndarray:
    """Bits per trigram under the model that trigram weights (all ``ALPHABET`` cubed of them) make: nine parts
    the share of the third character after the first two, one part an even share."""
    rows = weights.reshape(-1, ALPHABET).astype(np.float64)
    size = rows.sum(1, keepdims=True)
    floor = 1.0 / ALPHABET
    share = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    return -np.log2(np.where(size > 0, 0.9 * share + 0.1 * floor, floor)).ravel()


def cross_entropy(grams: np.ndarray, times: np.ndarray, model: np.ndarray) -> float | None:
    """Mean bits per character of the names a file has."""
    size = int(times.sum())
    return float((model[grams] * times).sum() / size) if size else None


def weights(times: np.ndarray, unit: int = 10_000) -> np.ndarray:
    """Trigram weights of one file: every file weighs the same, however many names it has."""
    return np.maximum(1, np.rint(unit * times / max(1, times.sum()))).astype(np.int64)


def naming_style(names: list[str]) -> dict[str, float]:
    """Shares of snake, camel, capitalized and other names among those of two words or more; ``n`` is their number."""
    kinds: Counter = Counter()
    for n in names:
        if "_" in n:
            kinds["snake" if n.islower() and n.strip("_").find("_") > 0 else "upper" if n.isupper() else ""] += 1
        elif not n.islower():
            kinds["pascal" if PASCAL.match(n) else "camel" if CAMEL.match(n) else ""] += 1
    kinds.pop("", None)
    size = sum(kinds.values())
    return {"n": size} | {k: c / size for k, c in kinds.items()} if size else {}
