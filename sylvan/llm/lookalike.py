"""One form for texts that look the same: widths, joined letters, blanks, invisible characters, scripts."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import regex

# -- fixed values: letters of one script that look like a letter of another ------------------------
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮЗЬԌԚԜаеѕіјорсухԁһԛԝӏ", "ABESIJKMHOPCTYXY3bGQWaesijopcyxdhqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳνϲ", "ABEZHIKMNOPTYXojvc"))
HYPHENS = "‐‑"
#: compatibility forms that differ from their plain letters in width, joining or breaking only
PLAIN = ("<wide>", "<narrow>", "<noBreak>", "<compat>")

for _foreign in "ЗЬ":  # a digit or a letter of another case does not look alike inside a word
    CYRILLIC.pop(_foreign)
TO_LATIN = CYRILLIC | GREEK
FROM_LATIN = {"Cyrillic": {}, "Greek": {}}
for _table, _script in ((CYRILLIC, "Cyrillic"), (GREEK, "Greek")):
    for _c, _l in _table.items():
        FROM_LATIN[_script].setdefault(_l, _c)

CHUNK = regex.compile(r"\S+")
TOKEN = regex.compile(r"[\p{L}\p{M}]+")
#: where a token is cut at changes of case; the vocabulary is counted by the same rules in Spark
CUTS = ((r"(\p{Ll})(\p{Lu})", "$1 $2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"))
_CUTS = [(regex.compile(a), b.replace("$", "\\")) for a, b in CUTS]
SCRIPTS = {"Latin": regex.compile(r"\p{Latin}"), "Cyrillic": regex.compile(r"\p{Cyrillic}"), "Greek": regex.compile(r"\p{Greek}")}
AMBIGUOUS = frozenset(TO_LATIN) | frozenset(TO_LATIN.values())
FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_same = regex.escape("".join(sorted(AMBIGUOUS)))
SURE = {name: regex.compile(rf"[\p{{{name}}}--[{_same}]]", regex.V1) for name in SCRIPTS}
_ODD = regex.compile(r"[^\t\n\x20-\x7e]")
_cache: dict[str, str] = {}


def _plain(c: str) -> str:
    """The plain form of one character; empty if it cannot be seen."""
    kind = unicodedata.category(c)
    if kind == "Cf" or "︀" <= c <= "️" or c in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    if kind == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in PLAIN:
        form = unicodedata.normalize("NFKC", c)
        if not form.startswith(" "):
            return form
    return c


def plain_form(text: str) -> str:
    """Folds width, joined letters, blanks of other width and invisible characters, and composes accents.

    Raised and lowered figures, circled letters, accents and case can be seen and stay."""
    if text.isascii():
        return text

    def one(m) -> str:
        c = m.group()
        if c not in _cache:
            _cache[c] = _plain(c)
        return _cache[c]

    return unicodedata.normalize("NFC", _ODD.sub(one, text))


@lru_cache(maxsize=1 << 14)
def script_of(c: str) -> str:
    if c.isascii():
        return "Latin" if c.isalpha() else ""
    for name, pattern in SCRIPTS.items():
        if pattern.match(c):
            return name
    return ""


def scripts_of(token: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in token:
        s = script_of(c)
        if s:
            out[s] = out.get(s, 0) + 1
    return out


def convert(token: str, script: str) -> str | None:
    """The token with every look-alike of another script replaced by the letter of ``script``; None if a
    letter has none."""
    out = []
    for c in token:
        s = script_of(c)
        if s in ("", script):
            out.append(c)
            continue
        latin = c if s == "Latin" else TO_LATIN.get(c)
        if latin is None and s != "Latin":
            base = unicodedata.normalize("NFD", c)
            if len(base) > 1 and base[0] in TO_LATIN:
                latin = TO_LATIN[base[0]] + base[1:]
        if latin is None:
            return None
        if script != "Latin":
            latin = FROM_LATIN[script].get(latin)
            if latin is None:
                return None
        out.append(latin)
    return unicodedata.normalize("NFC", "".join(out))


def pieces(token: str) -> list[str]:
    """Parts of a token at changes of case, in lower case: what the vocabulary counts."""
    for pattern, parts in _CUTS:
        token = pattern.sub(parts, token)
    return token.lower().split()


def candidates(token: str, context: str) -> list[str]:
    """Repairs of a token to try: towards each of its scripts, the dominant one first; for a token of one
    foreign script made of look-alikes only, towards the script around it (``context``)."""
    found = scripts_of(token)
    if not found or set(found) == {context}:
        return []
    first = leading_script(token)
    order = sorted(found, key=lambda s: (s != first, -found[s], s)) if len(found) > 1 else []
    order += [context] if context not in order else []
    out = []
    for script in order:
        form = convert(token, script)
        if form is not None and form != token and form not in out:
            out.append(form)
    return out


def tells(text: str) -> bool:
    """Whether a letter shows which script the text is in."""
    return any(p.search(text) for p in SURE.values())


def odd_tokens(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, token, candidates) of the tokens of a plain text that may hold look-alikes.

    The context of a token is the script of the other tokens in its run of non-blank characters (a file
    name, a call) where these tell, else that of its line, else that of the text."""
    if text.isascii() or not FOREIGN.search(text):
        return []  # all letters are Latin, whatever their accents
    whole, out = leading_script(text), []
    for chunk in CHUNK.finditer(text):
        if chunk.group().isascii() and whole == "Latin":
            continue
        tokens = list(TOKEN.finditer(text, chunk.start(), chunk.end()))
        for i, m in enumerate(tokens):
            context, near = whole, "x"
            if len(tokens) > 1:
                near = "".join(other.group() for j, other in enumerate(tokens) if j != i)
                if tells(near):
                    context = leading_script(near)
                    near = ""
            if near:  # the run of characters did not tell
                row = text[text.rfind("\n", 0, m.start()) + 1 : m.start()] + text[m.end() : text.find("\n", m.end()) % (len(text) + 1)]
                context = leading_script(row) if tells(row) else whole
            found = candidates(m.group(), context)
            if found:
                out.append((m.start(), m.end(), m.group(), found))
    return out


def leading_script(text: str) -> str:
    """The script of most letters that look like no letter of another script; where there are none, of
    most letters; Latin where there are no letters. Look-alikes prove nothing about the script they are in."""
    if text.isascii() or not FOREIGN.search(text):
        return "Latin"
    sure, all_ = dict.fromkeys(SCRIPTS, 0), dict.fromkeys(SCRIPTS, 0)
    for c, n in Counter(text).items():
        s = script_of(c)
        if s:
            all_[s] += n
            if c not in AMBIGUOUS:
                sure[s] += n
    for counts in (sure, all_):
        best = max(counts, key=lambda s: (counts[s], s))
        if counts[best]:
            return best
    return "Latin"
