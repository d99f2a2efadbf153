"""Words of evaluation items and documents, and how much of an item a document reproduces."""

from __future__ import annotations

import html
import re
import unicodedata

from sylvan.llm.lookalike import TO_LATIN, plain_form

#: a tag with its attributes, however long, or what is short enough to be one
TAG = re.compile(
    r"""</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?)*+\s*+/?>|</?[A-Za-z][^<>]{0,300}>"""
)
BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrt])(?![a-z]{0,2}\\)|([^\w\s]|_))")
WORD = re.compile(r"[^\W_](?:\w*[^\W_])?")
#: letters of scripts written without blanks between words: each is a word
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FOLDED = re.compile(f"[{''.join(TO_LATIN)}]")


def _marks() -> re.Pattern:
    """All characters that combine with the one before, as ranges."""
    runs: list[list[int]] = []
    for c in range(0x300, 0x20000):
        if unicodedata.combining(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")


MARKS = _marks()


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else " "
    return " " if m[2] else m[3]


def words(text: str) -> list[str]:
    """Words without layout, case, punctuation, markup or encoding of characters."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = ESCAPE.sub(_unescape, text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = BREAK.sub("", text)
    if not text.isascii():
        text = FOLDED.sub(lambda m: TO_LATIN[m[0]], plain_form(text))
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = UNSPACED.sub(r" \g<0> ", text)
    return WORD.findall(text.lower())


def stretches(item: list[int], doc, at: int, diagonal: int) -> tuple[int, int]:
    """The running stretch of the item around position ``at`` whose words stand in ``doc`` shifted by
    ``diagonal``. A single different word inside counts as exchanged if three equal words follow it."""
    n, m = len(item), len(doc)

    def same(i: int) -> bool:
        j = i + diagonal
        return 0 <= i < n and 0 <= j < m and item[i] == doc[j]

    low = high = at
    while True:
        if same(low - 1):
            low -= 1
        elif same(low - 2) and same(low - 3) and same(low - 4):
            low -= 4
        else:
            break
    while True:
        if same(high + 1):
            high += 1
        elif same(high + 2) and same(high + 3) and same(high + 4):
            high += 4
        else:
            break
    return low, high + 1
