"""Calls that happen later: a function of the file handed over to something that will call it.

Every call site of the file is cut into its arguments; what a language's registrars take is told by the
position or the keyword of the argument. Statements that call on their own (``go f()``) count too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from sylvan.extract.model import Lines, Result, closing, mask

SCRIPT, C_FAMILY = ("javascript", "typescript", "jsx", "tsx"), ("c", "cpp", "esqlc")


@dataclass(frozen=True)
class Registrar:
    """A callee that takes a function: the argument's position, or its keyword; ``member`` callees must
    stand behind a dot, ``owner`` names what stands before it."""

    callee: str
    argument: int | str
    member: bool = False
    owner: str = ""


# -- fixed values: callees that take a function, and where it stands -----------------------------------
_SCRIPT = [
    *(Registrar(n, 0) for n in ("setTimeout", "setInterval", "queueMicrotask")),
    *(Registrar(n, 0, member=True) for n in ("then", "catch", "finally", "map", "filter", "forEach", "some", "every", "find")),
    *(Registrar(n, 1, member=True) for n in ("on", "once", "addEventListener")),
]
REGISTRARS: dict[str, list[Registrar]] = {
    **dict.fromkeys(SCRIPT, _SCRIPT),
    "python": [Registrar("Thread", "target", True, "threading"), Registrar("register", 0, True, "atexit"), Registrar("map", 0), Registrar("filter", 0), Registrar("sorted", "key")],
    "go": [Registrar("HandleFunc", 1, True, "http")],
    "rust": [*(Registrar(n, 0, member=True) for n in ("map", "filter", "for_each", "find", "any", "all")), Registrar("spawn", 0, owner="thread")],
    **dict.fromkeys(C_FAMILY, [Registrar("signal", 1), Registrar("pthread_create", 2)]),
}
STATEMENTS = {"go": ("go", "defer")}

SITE = re.compile(r"(?:(\w+)\s*)?(\.|::|->)?\s*\b([A-Za-z_]\w*)\s*\(")
LEADING_NAME = re.compile(r"\s*&?([A-Za-z_]\w*)")


def arguments(code: str, opening: int) -> list[tuple[int, int]]:
    """(start, end) of the arguments of the call whose bracket opens at ``opening`` in a masked text."""
    end = closing(code, opening)
    out, depth, start = [], 0, opening + 1
    for i in range(opening + 1, end):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append((start, i))
            start = i + 1
    return [*out, (start, end)]


def handed_over(code: str, language: str):
    """(offset, name) of each function name handed to a registrar or started by a statement."""
    by_name: dict[str, list[Registrar]] = {}
    for r in REGISTRARS.get(language, ()):
        by_name.setdefault(r.callee, []).append(r)
    for site in SITE.finditer(code):
        for r in by_name.get(site[3], ()):
            if r.member and site[2] is None or r.owner and site[1] != r.owner:
                continue
            spans = arguments(code, site.end() - 1)
            if isinstance(r.argument, int):
                picked = spans[r.argument : r.argument + 1]
                at = picked[0][0] if picked else None
            else:
                keyed = (re.match(rf"\s*{r.argument}\s*=(?!=)", code[a:b]) for a, b in spans)
                at = next((a + m.end() for (a, _), m in zip(spans, keyed) if m), None)
            name = LEADING_NAME.match(code, at) if at is not None else None
            if name:
                yield name.start(1), name[1]
    for word in STATEMENTS.get(language, ()):
        for m in re.finditer(rf"\b{word}\s+([A-Za-z_]\w*)\s*\(", code):
            yield m.start(1), m[1]


def synthesize(out: Result, text: str, language: str) -> None:
    """Adds a call from the function around each registration (else from the file) to the function handed over."""
    if language not in REGISTRARS:
        return
    names = {s.name for s in out.symbols if s.kind in ("function", "method")}
    if not names:
        return
    have = {(e.source, e.target) for e in out.links if e.kind == "calls"}
    file = next((s for s in out.symbols if s.kind == "file"), None)
    lines = Lines(text)
    for at, name in handed_over(mask(text, language == "rust"), language):
        if name not in names:
            continue
        line = lines.at(at)[0]
        owner = out.innermost(line) or file
        if owner is None or owner.name == name or (owner.id, name) in have:
            continue
        have.add((owner.id, name))
        out.link(owner, name, "calls", line, 0, provenance="heuristic", metadata={"synthesizedBy": "callback", "registeredAt": f"{out.path}:{line}"})
