"""Search patterns and query words, as plain Python over the query text."""

from __future__ import annotations

import re

# -- fixed values: words that carry no search intent ------------------------------------------------
STOP_WORDS = frozenset(
    """the and for with from this that have been will would could should does done make made use used using work works find found show call called calling
    get set add all any how what when where which who why not but are was were has had its can did may also into than then them each other some such only
    same about after before between through during without again further once here there both just more most very being having doing system need needs want
    wants like look change changes changed changing layer handle handles handling incoming outgoing data flow flows level levels request requests response
    responses implement implements implementation interface interfaces class classes method methods trigger triggers affected affect affects else code return
    returns take takes check create read write start stop run runs running fix update task bug feature file files function type failing failed silently decide
    decides happen happens implemented robust mode""".split()
)


def like_pattern(pattern: str) -> str:
    """``*`` and ``?`` become ``%`` and ``_``; raw ``%`` and ``_`` stay wildcards; a pattern with none of
    these is a prefix search. Backslashes are doubled, as LIKE would take them for escapes."""
    out = pattern.replace("*", "%").replace("?", "_")
    if not re.search(r"[%_]", out):
        out += "%"
    return out.replace("\\", "\\\\")


def rank_term(pattern: str) -> str:
    """The pattern without trailing wildcards: what an exact hit must equal."""
    return pattern.rstrip("*?%_")


def split_identifier(name: str) -> list[str]:
    """Lower-case parts of an identifier, three letters or longer, without stop words."""
    text = re.sub(r"[_.\-]", " ", name)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return [p for p in text.lower().split() if len(p) >= 3 and p not in STOP_WORDS]


def _undouble(base: str) -> list[str]:
    return [base[:-1]] if len(base) > 1 and base[-1] == base[-2] else []


def stem_variants(term: str) -> list[str]:
    """Other forms of a word to search for: without ing, er, ed, plural s, ment, and half of tion."""
    t, out = term.lower(), set()
    n = len(t)
    if t.endswith("ing") and n > 5:
        out |= {t[:-3], t[:-3] + "e", *_undouble(t[:-3])}
    if t.endswith(("tion", "sion")) and n > 5:
        out.add(t[:-3])
    if t.endswith("ment") and n > 6:
        out.add(t[:-4])
    if n > 4:
        if t.endswith("ies"):
            out.add(t[:-3] + "y")
        elif t.endswith("es"):
            out.add(t[:-2])
        elif t.endswith("s") and not t.endswith("ss"):
            out.add(t[:-1])
        if t.endswith("ed") and not t.endswith("eed"):
            out |= {t[:-1], t[:-2]}
            if t.endswith("ied") and n > 5:
                out.add(t[:-3] + "y")
        if t.endswith("er"):
            out |= {t[:-2], t[:-2] + "e", *_undouble(t[:-2])}
    return sorted(v for v in out if len(v) >= 3 and v != t and v not in STOP_WORDS)


def identifier_like(token: str) -> bool:
    return "_" in token or "." in token or any(c.isupper() for c in token) or bool(token) and all(c.isdigit() for c in token)


def query_symbols(query: str) -> list[str]:
    """Tokens of a query that look like identifiers, with the parts of dotted ones, sorted."""
    out = set()
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", query):
        token = token.strip(".")
        if len(token) >= 3 and identifier_like(token) and token.lower() not in STOP_WORDS:
            out.add(token)
            out |= {p for p in token.split(".") if len(p) >= 3 and p.lower() not in STOP_WORDS}
    return sorted(out)


def query_terms(query: str) -> list[str]:
    """Search words of a query in order: parts of its tokens, each followed by its other forms."""
    out: list[str] = []
    for token in re.findall(r"[A-Za-z0-9_.\-]+", query):
        for part in split_identifier(token):
            for form in [part, *stem_variants(part)]:
                if form not in out:
                    out.append(form)
    return out


def term_groups(terms: list[str]) -> list[list[str]]:
    """Words that contain each other count as one idea: grouped greedily, longest first."""
    groups: list[list[str]] = []
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        for group in groups:
            if any(term in other or other in term for other in group):
                group.append(term)
                break
        else:
            groups.append([term])
    return groups


def title_case(term: str) -> str:
    return term[:1].upper() + term[1:].lower()


def match_terms(query: str) -> list[str]:
    """Words of a full-text query: split at anything but letters, digits and ``_``, two bytes or longer."""
    return [w for w in re.split(r"[^\w]+", query) if len(w.encode()) >= 2]


def explore_terms(query: str) -> list[str]:
    stop = {"the", "and", "for", "how", "does", "what", "where", "with", "from", "this"}
    return list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) >= 2 and w not in stop))


def parse_query(query: str) -> tuple[str | None, str | None, list[str]]:
    """``kind:`` and ``file:`` filters and the remaining words of a search query."""
    kind = file = None
    words = []
    for part in query.split():
        if part.startswith("kind:"):
            kind = part[5:].lower()
        elif part.startswith("file:"):
            file = part[5:]
        else:
            words.append(part)
    return kind, file, words


def mentions_tests(query: str) -> bool:
    q = query.lower()
    return "test" in q or "spec" in q


def compact_reason(reason: str) -> str:
    reason = reason.strip()
    return reason if len(reason) <= 48 else reason[:47] + "…"


def human_bytes(n: int) -> str:
    size, units = float(n), ["B", "KB", "MB", "GB", "TB"]
    for unit in units:
        if size < 1024 or unit == units[-1]:
            return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{n} B"


def truncate(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[: max(0, limit - 3)] + "..."


def identifier_at(line: str, column: int) -> str | None:
    """Identifier around a 0-based column (or ending at it)."""
    for m in re.finditer(r"[A-Za-z_$][\w$]*", line):
        if m.start() <= column <= m.end():
            return m.group()
    return None
