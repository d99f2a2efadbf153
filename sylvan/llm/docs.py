"""Signatures and documentation comments as small syntax trees, and whether a comment says anything."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

IDENT = re.compile(r"[^\W\d_]\w*|_\w+")
AFTER_NAME = re.compile(r"\s*(?:<[^()]*>)?\s*\(")
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


@dataclass
class Function:
    """What a signature declares."""

    name: str
    params: list[tuple[str, str]] = field(default_factory=list)
    returns: str = ""
    modifiers: str = ""

    def words(self) -> set[str]:
        text = " ".join([self.name, self.modifiers, self.returns, *(f"{n} {t}" for n, t in self.params)])
        return {stem(p) for w in IDENT.findall(text) for p in [w, *PIECE.findall(w)]} | {stem(w.replace("_", "")) for w in IDENT.findall(text)}


def group_end(text: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{<") - (text[i] in ")]}" or text[i] == ">" and text[i - 1] not in "-=")
        if depth == 0:
            return i
    return len(text)


def split_params(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or c == ">" and text[i - 1] not in "-=")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def parse_param(text: str, language: str) -> tuple[str, str]:
    text = text.split("=", 1)[0].strip()
    if ":" in text and "::" not in text.split(":", 1)[0] + ":" + text.split(":", 1)[1][:1]:
        name, kind = text.split(":", 1)
        return name.strip(" *&?.").removeprefix("mut ").strip(), kind.strip()
    names = IDENT.findall(text)
    if not names:
        return "", text
    if language in ("c", "cpp", "esqlc") and len(names) > 1:
        return names[-1], text[: text.rfind(names[-1])].strip()
    if language == "go" and len(names) > 1:
        return names[0], text[text.find(names[0]) + len(names[0]) :].strip()
    return names[0] if len(names) == 1 else names[-1], " ".join(names[:-1])


def parse_signature(signature: str, name: str, language: str) -> Function:
    """Name, parameters, result type and modifiers; without the name the first group of parameters."""
    at = -1
    start = signature.find(name) if name else -1
    while start >= 0 and at < 0:
        m = AFTER_NAME.match(signature, start + len(name))
        if m:
            at, head = m.end() - 1, signature[:start]
        start = signature.find(name, start + 1)
    if at < 0:
        at = signature.find("(")
        head = signature if at < 0 else signature[:at]
    if at < 0:
        return Function(name, [], "", head)
    end = group_end(signature, at)
    params = [parse_param(p, language) for p in split_params(signature[at + 1 : end])]
    return Function(name, params, signature[end + 1 :].strip(" :{"), head)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Folds the endings by which a verb or noun of a name is bent in a sentence."""
    w = word.lower()
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 4 and w.endswith("ied"):
        w = w[:-3] + "y"
    elif len(w) > 5 and w.endswith("ing"):
        w = w[:-3]
    elif len(w) > 4 and w.endswith(("es", "ed", "er")):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s"):
        w = w[:-1]
    if len(w) > 3 and w.endswith("e"):
        w = w[:-1]
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w


# -- fixed values: what carries no statement ------------------------------------------------------
FILLER = frozenset(
    stem(w)
    for w in """a an the of to for in on at by with and or as from into this that these those it its is are be was were will
    function functions method methods procedure routine subroutine helper constructor used use uses using given specified supplied provided
    does do did performs perform implements implementation returns return returned yields value values result results output input parameter
    parameters param params argument arguments arg args name named type types typed object instance class struct self cls none null void
    die der das ein eine funktion methode für la le les un une fonction méthode de du des el los las una función método
    get gets set sets or den dem des gibt zurück liefert setzt renvoie retourne devuelve возвращает
    def fn func pub async export static const int let var""".split()
)
CONNECTIVES = frozenset(
    stem(w) for w in "and or but not no if unless when while until before after since once at by in on over under per with without because so than then only even all any each every".split()
)
LABEL = re.compile(
    r"^(?:function|method|name|parameters?|params?|args|arguments?|inputs?|outputs?|returns?|return value|yields?|raises?|throws|exceptions?|errors?|notes?|description|summary|brief|"
    r"details?|type|usage|examples?|synopsis)\s*:(?!:)\s*",
    re.I,
)
ITEM = re.compile(r"^[-*]?\s*([\w$]+)(?:\s*\([^)]*\))?\s*:\s+(.*)$")
FIELD = re.compile(
    r"^(?:[@\\](?P<tag>[A-Za-z-]+)\b|:(?P<field>[a-z]+)(?P<of>[^:\n]*):(?!:))\s*(?P<rest>.*)$",
    re.S,
)
STATING = frozenset(
    "param params parameter arg argument return returns result throws throw raises raise exception except tparam yields yield brief summary desc description details note "
    "remarks remark warning pre post precondition postcondition invariant example property prop attribute var ivar keyword key kwarg".split()
)
NAMED = frozenset("param params parameter arg argument tparam throws throw raises raise exception except property prop attribute var ivar keyword key kwarg".split())
REMINDER = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip|bug|optimi[sz]e|revisit)\b", re.I)
DIRECTIVE = re.compile(
    r"^\W*(?:noqa|nosec|nolint\w*|type:\s*ignore|pylint:|pyright:|mypy:|flake8[:\s]|ruff:|isort:|yapf:|fmt:\s*(?:off|on|skip)|black:|pragma\b|coverage:|eslint[- ]|tslint:|jshint|jslint|"
    r"prettier-ignore|biome-ignore|@?ts-(?:ignore|nocheck|expect-error|check)|istanbul\b|c8 ignore|clang-format (?:off|on)|clang-tidy|cppcheck-suppress|"
    r"iwyu pragma|go:\w+|\+build|golint|nolint|rustfmt::|rubocop:|shellcheck (?:disable|source)|spell-?checker:|cspell:|sonar\b|codeql|lgtm\b|region\b|endregion\b|vim?:|-\*-)",
    re.I,
)
REFERENCE = re.compile(
    r"^\W*(?:(?:please )?(?:see|refer to|cf\.?|compare|same as|like|as in|as for|siehe|vgl\.?|voir|véase|ver|consulte|см\.?)(?: also| the| auch| aussi| también)?"
    r"(?: (?:above|below|there|elsewhere|overleaf|parent|base|super|interface|docs?|documentation|manual|wiki|readme|oben|unten|dort|ci-dessus|plus haut|arriba|abajo|выше|\S*[_./:#(]\S*|[A-Za-z]+[A-Z]\w*|"
    r"(?:parent|base|super|the) (?:class|method|function|implementation)|section \S+|issue \S+))+|ditto|idem|dito|as above|as below|wie oben|inherited|inherits? docs?|\{@\w+[^}]*\}|https?://\S+)\W*$",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:tbd|tbc|n ?/ ?a|none|null|nil|empty|undocumented|unspecified|placeholder|descriptions?|documentation|docs?|docstring|summary|comment|stub|dummy|lorem ipsum.*|coming soon|work in progress|wip|"
    r"fill (?:me|this|it) in.*|your (?:description|text|documentation|docs|comment) here|"
    r"(?:no|missing|insert|add|write|put|enter|provide|needs?|lacks?|without|give) (?:an? |the |some |your |more |any |proper )?(?:description|documentation|docs?|docstring|doc ?comments?|comments?|summary|text|explanation)"
    r"(?: (?:here|available|yet|provided|given|later|found|needed|please|exists?))*|"
    r"(?:description|documentation|docs?|docstring|comment|text|summary) (?:goes|comes|to come|to be|to follow|is missing|missing|pending|here|needed|follows|wanted|required|coming|later|unavailable|not available).*|"
    r"(?:auto-?\s?generated|automatically generated|generated|todo) (?:\w+ )?(?:method|function|constructor|catch|class)?\s*(?:stub|block|comment|doc\w*)|"
    r"(?:not|yet to be|to be|still to be) (?:yet |be )?(?:documented|described|done|written|added|completed|defined|determined|filled in)(?: yet| later)?|"
    r"zu dokumentieren|noch (?:nicht dokumentiert|zu dokumentieren|offen)|(?:beschreibung|dokumentation) (?:folgt|fehlt|ausstehend|kommt noch)|keine (?:beschreibung|dokumentation).*|nicht dokumentiert|"
    r"(?:description|documentation) (?:à venir|manquante|à compléter|à rédiger)|à (?:documenter|compléter|rédiger|faire)|non documentée?|pas de (?:description|documentation).*|aucune (?:description|documentation).*|"
    r"por (?:documentar|hacer|completar|definir)|sin (?:descripción|documentar|documentación)|(?:descripción|documentación) (?:pendiente|faltante)|pendiente(?: de documentar)?|"
    r"(?:описание|документация) (?:отсутствует|позже|будет позже|следует|появится позже)|нет (?:описания|документации)|не документировано|без описания|задокументировать)\W*$",
    re.I,
)
LEGAL = re.compile(
    r"^\W*(?:copyright\b|©|\(c\) (?:19|20)\d\d)|\ball rights reserved|\bspdx-|\blicen[sc]ed (?:under|to you under)\b|\bunder the terms (?:and conditions )?of\b.*\blicen[sc]e|"
    r"\bsee (?:the )?(?:accompanying |file )?(?:licen[sc]e|copying)\b(?: file| for| in|\W*$)|\b(?:the|gnu|general public|mit|apache|bsd|mozilla)[\w ]{0,20} licen[sc]e(?:,? (?:version|v)\W?\d|\W*$)|"
    r"\bwithout (?:any )?(?:express or implied |implied )?(?:warrant(?:y|ies)|conditions of any kind)|\bno warrant(?:y|ies)\b|\bdisclaims? (?:all|any)\b|\bconditions of any kind\b|"
    r"\b(?:provided|handed out|distributed|supplied|delivered|offered)\b.{0,40}\bas[- ](?:it[- ])?is\b|\bas[- ]is\b.*\bbasis|\bthis notice (?:stays|remains|must|shall|is kept|and)\b|"
    r"\bredistribution(?:s)? (?:and use|of source|in binary)|\bpermission is hereby\b|\bpatent (?:licen[sc]e|grant|rights?) (?:is|are|as)\b|"
    r"alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|все права защищены",
    re.I,
)
MARKER = re.compile(r"^\s*(?:/\*\*?!?|\*/|\*(?!\*)|///?!?|##?!?(?=\s|$|\W|\w)|--+\||--(?=\s|$)|;+(?=\s|$)|%+(?=\s|$)|\"\"\"|'''|<!--|\(\*)+[ \t]?")
TAIL = re.compile(r"(?:\*+/|\"\"\"|'''|-->|\*\))\s*$")


@dataclass
class Statement:
    """A piece of documentation: the tag it stands under (empty for free text), the tag's subject, the text."""

    tag: str
    subject: str
    text: str


def strip_markers(docstring: str) -> list[str]:
    lines = []
    for raw in docstring.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = TAIL.sub("", raw)
        previous = None
        while previous != line:
            previous = line
            line = MARKER.sub("", line, count=1)
        lines.append(line.strip())
    return lines


def parse_docstring(docstring: str) -> list[Statement]:
    """Statements in order: each tag with its text, and the free text cut into sentences."""
    out: list[Statement] = []
    tag, subject, run = "", "", []
    section = False  # inside a list of parameters opened by a label

    def close() -> None:
        text = " ".join(run).strip()
        if tag:
            out.append(Statement(tag, subject, text))
        elif text:
            out.extend(Statement("", "", s) for s in re.split(r"(?<=[.!?;])\s+", text))
        run.clear()

    for line in strip_markers(docstring):
        m = FIELD.match(line)
        if m:
            close()
            tag = (m["tag"] or m["field"]).lower()
            subject, rest = (m["of"] or "").strip(), m["rest"].strip()
            if tag in NAMED and not subject:
                rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
                first = re.match(r"\[?([\w.$*&]+)\]?\s*(?:[-:]\s+)?", rest)
                if first:
                    subject, rest = first[1], rest[first.end() :]
            run.append(rest)
        elif section and ITEM.match(line):
            close()
            m = ITEM.match(line)
            tag, subject = "param", m[1]
            run.append(m[2])
        elif not line:
            close()
            tag = subject = ""
            section = False
        elif REMINDER.match(line) or DIRECTIVE.match(line) or not re.search(r"\w", line):
            close()
            tag = subject = ""
            out.append(Statement("skip", "", line))
        else:
            label = LABEL.match(line)
            if label:
                close()
                tag = subject = ""
                line = line[label.end() :]
                section = not line and label.group().lower().startswith(("arg", "param"))
                if label.group().lower().startswith(("arg", "param")) and re.fullmatch(r"[\w$]+(?:\s*,\s*[\w$]+)*", line):
                    line = ""  # only the parameters' names
            run.append(line)
            if label:
                close()
    close()
    return out


def only_echoes(text: str, name: str) -> bool:
    """The name's words and then only a few bare words: the name and the parameters of a function whose
    signature cannot list them (a shell function)."""
    words = [stem(w) for w in re.findall(r"\w+", text)]
    own = [stem(p) for p in PIECE.findall(name)]
    rest = words[len(own) :]
    return words[: len(own)] == own and len(rest) <= 3 and not re.search(r"[^\w\s(),.!:]", text) and not any(w in CONNECTIVES for w in rest)


def says_something(statement: Statement, known: set[str], bare: str = "") -> bool:
    """A real statement: not empty, no ruler, reminder, directive, reference, notice or placeholder, and with
    a word that neither the signature nor ordinary wording about signatures holds."""
    if statement.tag and statement.tag not in STATING:
        return False
    text = statement.text.strip()
    if not re.search(r"\w", text):
        return False
    if PLACEHOLDER.match(text) or REFERENCE.match(text) or DIRECTIVE.match(text) or LEGAL.search(text) or REMINDER.match(text):
        return False
    if bare and only_echoes(text, bare):
        return False
    subject = {stem(p) for w in IDENT.findall(statement.subject) for p in [w, *PIECE.findall(w)]}
    for word in re.findall(r"\w+", text):
        if stem(word) in known or stem(word) in FILLER:
            continue
        for piece in PIECE.findall(word):
            s = stem(piece)
            if s not in known and s not in FILLER and s not in subject:
                return True
    return False


def from_tree(name: str, params: list[str], returns: str, head: str, language: str) -> Function:
    """The function of a syntax tree in the form signatures are read into."""
    return Function(name, [parse_param(p, language) for p in params], returns.strip(" :{"), head)


def describe(
    docstring: str | None, name: str | None, signature: str | None, language: str | None, tree: Function | None = None
) -> tuple[Function | None, str | None]:
    """The function and the statements that say something, joined; None where there are none.

    ``tree`` is the function as the syntax tree of its file has it; without one the signature is parsed."""
    if signature is None or not signature.strip():
        return None, None
    function = tree or parse_signature(signature, name or "", language or "")
    if docstring is None or not docstring.strip():
        return function, None
    known = function.words()
    bare = function.name if language == "shell" else ""
    said = [s for s in parse_docstring(docstring) if says_something(s, known, bare)]
    if not said:
        return function, None
    return function, "\n".join(f"{s.tag} {s.subject}: {s.text}" if s.tag and s.subject else f"{s.tag}: {s.text}" if s.tag else s.text for s in said)
