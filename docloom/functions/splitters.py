"""Text splitters that need state: sentences, sections, rows.

Plain functions from a text to pieces ``[(text, offset)]``; ``operators.chunk`` calls them from one
Arrow function.  A text is tokenised once; sentence ends and line starts are sorted lists of token
numbers, and packing looks up its next cut in them by bisection, so a text costs about one pass
whatever its chunks.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: White space (the ECMAScript set).
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# Scripts written without spaces, which select tokens by grapheme.
UNSPACED = re.compile(
    "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3000-\u303f\u3040-\u309f\u30a0-\u30ff\u31f0-\u31ff\uac00-\ud7af"  # Han, kana, Hangul
    "\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f]"  # Thai, Lao, Khmer, Myanmar
)

# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("Mr. Mrs. Ms. Dr. Prof. St. Jr. Sr. Inc. Ltd. Corp. vs. etc. approx. dept. est. govt. apt. Ave. Blvd.".split())

# Signs that end a sentence, and signs that may close it.
_STOPPING = ".?!\u3002\uff01\uff1f\u0964"
_CLOSING = "\"'\u00bb)\\]}"
CLOSERS = re.compile("[\"'\u00bb)\\]}]+")

_STOPS = re.compile(f"[{_STOPPING}]")
_BREAK = re.compile("[\n\r]+")


@dataclass
class Tokens:
    text: str
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    #: Tokens that are first after a line break.
    fresh: list[int] = field(default_factory=list)
    #: Tokens that end a sentence, and where the sentence ends, behind its closers.
    stops: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    #: Tokens before which a sentence ends for want of a sign.
    opens: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def sentence_end(self, first: int) -> int:
        """One past the last token of the sentence that holds token ``first``."""
        s, o = bisect_left(self.stops, first), bisect_right(self.opens, first)
        stop = self.stops[s] if s < len(self.stops) else len(self)
        if o < len(self.opens) and self.opens[o] < stop:
            return self.opens[o]
        return self.after[s] if s < len(self.stops) else len(self)


def _graphemes(text: str):
    """(start, end) of tokens in scripts without spaces: runs of letters or of digits, and single
    clusters of anything else, equal neighbours together."""
    import regex

    kind = at = None
    sign = ""
    for m in regex.finditer(r"\X", text):
        g = m.group()
        if re.search(f"[{SPACES}]", g):
            now = None
        elif re.search("[0-9]", g):
            now = "digit"
        elif re.search("[^A-Za-z0-9_]", g) or g == "_":
            now = "sign"
        else:
            now = "letter"
        same = now is not None and now == kind and (now != "sign" or g == sign)
        if not same:
            if kind is not None:
                yield at, m.start()
            kind, at, sign = now, m.start(), g
    if kind is not None:
        yield at, len(text)


@cache
def _kinds() -> np.ndarray:
    """Code point -> 0 white space, 1 letter, 2 digit, a number of its own for any other sign."""
    out = np.arange(3, 3 + 0x110000, dtype=np.uint32)
    for kind, signs in enumerate((SPACES, string.ascii_letters, string.digits)):
        out[[ord(c) for c in signs]] = kind
    return out


def _runs(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of tokens: ASCII letters, ASCII digits, or a run of one other sign."""
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(kind):
        return [], []
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(first[1:], len(kind))
    shown = kind[first] != 0
    return first[shown].tolist(), end[shown].tolist()


def tokenize(text: str) -> Tokens:
    if UNSPACED.search(text[:200]):
        spans = list(_graphemes(text))
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
    else:
        starts, ends = _runs(text)
    out, n = Tokens(text, starts, ends), len(starts)
    # white space lies between tokens, and a token's last sign decides whether it ends a sentence
    out.fresh = [i for i in sorted({bisect_left(starts, m.start()) for m in _BREAK.finditer(text)}) if i < n]
    for m in _STOPS.finditer(text):
        i = bisect_left(ends, m.end())
        if i == n or ends[i] != m.end():
            continue
        word = out.word(i)
        if word in ABBREVIATIONS or i and out.word(i - 1) + word in ABBREVIATIONS:
            continue
        out.stops.append(i)
        j = i + 1
        while j < n and text[starts[j]] in _CLOSING and CLOSERS.fullmatch(text, starts[j], ends[j]):
            j += 1
        out.after.append(j)
    out.opens = [i for i in out.fresh if not "a" <= text[starts[i]] <= "z" and text[ends[i] - 1] not in _STOPPING]
    return out


def sentences(text: str, most: int) -> list[tuple[str, int]]:
    """Pieces of whole sentences up to ``most`` characters; longer sentences are cut, at line
    breaks if they have some, and a token always stays whole."""
    t = tokenize(text)
    out, at, n = [], 0, len(t)

    def fits(first: int, end: int) -> bool:
        return t.ends[end - 1] - t.starts[first] <= most

    while at < n:
        end = t.sentence_end(at)
        if fits(at, end):
            while end < n:
                nxt = t.sentence_end(end)
                if not (fits(at, nxt) and fits(end, nxt)):
                    break
                end = nxt
        elif end - at > 1:
            over = bisect_right(t.ends, t.starts[at] + most, at, end)  # first token that reaches beyond
            line = bisect_right(t.fresh, min(over, end - 1)) - 1
            cut = t.fresh[line] if line >= 0 and t.fresh[line] > at else over
            end = max(at + 1, cut)
        out.append((text[t.starts[at] : t.ends[end - 1]], t.starts[at]))
        at = end
    return out


_HEADING = re.compile(f"^#{{1,6}}[{SPACES.replace(chr(10), '')}]", re.M)


def sections(text: str, most: int) -> list[tuple[str, int]]:
    """Sections that start at headings, small ones together; one that is too long is cut by sentences."""
    at = [0, *(m.start() for m in _HEADING.finditer(text) if m.start() and text[m.start() - 1] == "\n")]
    ends = [a - 1 for a in at[1:]] + [len(text)]
    out: list[tuple[str, int]] = []
    first, held = None, 0  # the open run of sections, and its length with a line feed for each

    def close(end: int) -> None:
        nonlocal first, held
        if first is not None:
            out.append((text[first:end], first))
        first, held = None, 0

    last = 0
    for a, b in zip(at, ends):
        size = b - a
        if size > most or held + size + 1 > most:
            close(last)
        if size > most:
            out.extend((piece, a + off) for piece, off in sentences(text[a:b], most))
            continue
        first = a if first is None else first
        held, last = held + size + 1, b
    close(last)
    return out


_RULE = re.compile(f"\\|[{SPACES}\\-:|]+\\|")


def rows(text: str, most: int) -> list[tuple[str, int]]:
    """Lines packed up to ``most`` characters; a table's head is repeated on each of its pieces.

    A line costs its length and one.  The offset of a piece counts what the pieces before it cost,
    repeated heads included."""
    out: list[tuple[str, int]] = []
    lines: list[str] = []
    head: list[str] | None = None  # of the table we are in
    cost = offset = 0
    for line in text.split("\n"):
        price = len(line) + 1
        is_row = line.lstrip(SPACES).startswith("|")
        if not is_row:
            head = None
        elif head is None:
            head = []
        opening = is_row and (not head or len(head) == 1 and _RULE.fullmatch(line.strip(SPACES)))
        if opening:
            head.append(line)
        elif lines and cost + price > most:
            out.append(("\n".join(lines), offset))
            offset += cost
            lines = list(head or ())
            cost = sum(len(x) + 1 for x in lines)
        lines.append(line)
        cost += price
    out.append(("\n".join(lines), offset))
    return out


SPLITTERS = {"sentence": sentences, "structural": sections, "row": rows}
