"""Personal data (operator 10): patterns, and a linear-chain CRF over word shapes.

The base patterns are the contract's own.  The CRF finds what they miss: spelled-out addresses
("ann at mail dot example dot com"), national telephone formats, IPv4 numbers written with other
separators, card numbers grouped by dots, slashes or colons.  It is trained here, from the small labelled
table that ``labelled_table`` builds from templates, by gradient ascent on the conditional
likelihood, and decoded by Viterbi in numpy batches.

A plain word between plain words can only be O: that is a constraint of the model, in training as
in decoding.  Such words cut a text into short stretches, each preceded and followed by O, whose
best paths are independent of each other, so they are decoded exactly, thousands in one batch.
Whether a word's digits pass Luhn is part of its shape, numbers that fail are among the training
table's negatives, and a found card or IPv4 number has to be a valid one.

Defined cases: null and empty texts have no spans.  Base spans stay as they are; a CRF span that
overlaps a base span is dropped.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes, tidy

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that take time in proportion to the text: an address is
# looked for around each @, and four numbers only where a run of digits starts (a match from inside
# a run would match from its start too, and no match ends inside one).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        free = at + 1  # what lies before cannot reach a later @
        if host:
            free = host.end()
            out.append((start, free, 0))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, sorted by start, then kind."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out)


_MAYBE = re.compile(rb"[0-9@+]")
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------------------------------- shapes

#: Words that matter by themselves; all others count by shape.
_CUES = frozenset("at dot call phone tel telephone fax mobile mail email e-mail contact reach ip address host server card visa account number no".split())
_EDGE = b".,;:!?\"'"


def shape(word: bytes) -> str:
    """Shape class of a word: a cue, 'w' (plain), or its shape if it holds digits or signs: x for
    letters; d, t, q, n, c, z for one or two, three, four, up to 11, up to 19 and more digits; with
    a leading * if all its digits could be a card's."""
    core = word.strip(_EDGE)
    text = core.decode("utf-8", "replace")
    if text.lower() in _CUES:
        return "=" + text.lower()
    if not re.search(r"[0-9@+]", text):
        if re.fullmatch(r"[a-z]+(\.[a-z]+)*", text) and text in _DOMAINS:
            return "=com"
        return "w"
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", text, re.S):
        g = m.group()
        if g[0] in "0123456789":
            n = len(g)
            out.append("d" if n < 3 else "t" if n == 3 else "q" if n == 4 else "n" if n < 12 else "c" if n < 20 else "z")
        elif g[0].isalpha():
            out.append("x")
        else:
            out.append(g)
        if len(out) > 12:
            break
    return ("*" if len(text) < 64 and _is_card(text) else "") + "".join(out)


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def plausible(text: str, kind: int) -> bool:
    """Whether what the CRF found can be of its kind: a card passes Luhn, an IPv4 number has four parts up to 255."""
    if kind == 2:
        return _is_card(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    return True


#: Endings of host names.
_DOMAINS = frozenset("com org net edu gov io info example".split())

LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")


def labelled_table(n: int = 600, seed: int = 11) -> list[tuple[list[bytes], list[int]]]:
    """The training table: words and labels of ``n`` generated lines, with hard negatives."""
    rng = np.random.default_rng(seed)

    def digits(k):
        return "".join(str(rng.integers(10)) for _ in range(k))

    def plain(k):
        return [("".join(rng.choice(list("aeiorstnlh"), rng.integers(2, 9)))) + str(rng.choice(["", "", "", ",", "."])) for _ in range(k)]

    def number(valid):
        """Sixteen digits in fours that pass Luhn or don't."""
        while True:
            got = ["4" + digits(3), digits(4), digits(4), digits(4)]
            if luhn("".join(got)) == valid:
                return got

    def part():
        a, b, c = digits(3), digits(3), digits(4)
        ip = [str(rng.integers(1, 255)) for _ in range(4)]
        name = "".join(rng.choice(list("aeiorstnlh"), 5))
        card = number(True)
        return [
            ("email", [name, "at", "mail", "dot", "example", "dot", "com"]),
            ("email", [name, "at", name, "dot", "com"]),
            ("email", [name, "at", name, "dot", "org"]),
            ("email", [f"{name}@localhost"]),
            ("email", [f"{name}.{digits(2)}@mail{digits(1)}.example.com"]),
            ("ip", [".".join(ip)]),
            ("ip", ["-".join(x.zfill(3) for x in ip)]),
            ("card", ["".join(card)]),
            ("card", [".".join(card)]),
            ("card", ["/".join(card)]),
            ("card", [":".join(card)]),
            ("phone", [f"({a})", f"{b}-{c}"]),
            ("phone", ["+1", f"({a})", f"{b}-{c}"]),
            ("phone", [f"{a}-{b}-{c}"]),
            ("phone", [f"{a}.{b}.{c}"]),
        ][rng.integers(15)]

    def noise():
        return [
            [digits(rng.integers(1, 5))],
            [f"{digits(2)}.{digits(2)}.{digits(4)}"],
            [f"{digits(4)}-{digits(2)}-{digits(2)}"],
            [f"{digits(1)}.{digits(2)}"],
            [f"{digits(1)}.{digits(1)}.{digits(1)}"],
            [f"{digits(2)}:{digits(2)}"],
            [f"{digits(3)}-{digits(3)}"],
            ["look", "at", "the", "dot", "com"],
            ["number", digits(3), "at", "home"],
            [f"x{digits(2)}y{digits(3)}z"],
            [f"{digits(2)}x{digits(3)}q{digits(1)}"],
            [f"key={digits(2)}ab{digits(3)}c"],
            [f"({digits(2)})"],
            [digits(rng.integers(20, 26))],
            ["+", digits(1)],
            [f"{digits(1)}+{digits(1)}"],
            ["call", "the", "server"],
            ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), rng.integers(8, 24)))],
            ["key=" + "".join(rng.choice(list("abcdef0123456789"), rng.integers(8, 24)))],
            ["".join(rng.choice(list("abcdef0123456789"), rng.integers(8, 44)))],
            ["".join(number(False))],
            [rng.choice(list("./:-")).join(number(False))],
            number(False),
            [digits(rng.integers(12, 20))],
        ][rng.integers(24)]

    out = []
    for _ in range(n):
        words, tags = plain(rng.integers(1, 7)), []
        tags = [0] * len(words)
        for _ in range(rng.integers(0, 3)):
            if rng.random() < 0.5:
                kind, ws = part()
                k = 1 + 2 * KINDS.index(kind)
                tags += [k] + [k + 1] * (len(ws) - 1)
            else:
                ws = noise()
                tags += [0] * len(ws)
            words += ws
            more = plain(rng.integers(0, 6))
            words += more
            tags += [0] * len(more)
        out.append(([w.encode() for w in words], tags))
    return out


# ------------------------------------------------------------------------------------------- CRF


@dataclass
class CRF:
    """Weights by shape class of the word, the one before and the one after, and transitions.

    Class 0 is the text's edge, class 1 the plain word, class 2 any shape training didn't show."""

    classes: dict[str, int]
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """(..., length + 2) classes with an edge or neighbour at either end -> (..., length, labels)."""
        e = self.here[c[..., 1:-1]] + self.before[c[..., :-2]] + self.after[c[..., 2:]]
        e[_only_o(c), 1:] = _BARRED
        return e

    def viterbi(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences between O's; c (n, longest + 2) holds classes with an edge before and behind."""
        n, longest = c.shape[0], c.shape[1] - 2
        best = np.zeros((n, longest), np.int8)
        if not n or not longest:
            return best
        e = self.emissions(c)
        back = np.zeros((n, longest, len(LABELS)), np.int8)
        score = e[:, 0] + self.moves[0]
        final = score.copy()
        for t in range(1, longest):
            step = score[:, :, None] + self.moves[None]
            back[:, t] = step.argmax(1)
            score = step.max(1) + e[:, t]
            final = np.where((lengths > t)[:, None], score, final)
        at = (final + self.moves[:, 0]).argmax(1)
        for t in range(longest - 1, -1, -1):
            live = lengths > t
            best[live, t] = at[live]
            at = np.where(live, np.take_along_axis(back[:, t], at[:, None], 1)[:, 0], at)
        return best


_BARRED = -1e4


def _only_o(c: np.ndarray) -> np.ndarray:
    """Words that can only be O: plain ones between plain ones or edges."""
    return (c[..., 1:-1] == 1) & (c[..., :-2] <= 1) & (c[..., 2:] <= 1)


def train_crf(table=None, epochs: int = 120, rate: float = 0.15, l2: float = 0.02) -> CRF:
    """Adam on the regularised conditional likelihood; all sequences padded into one batch."""
    table = labelled_table() if table is None else table
    classes = {"": 0, "w": 1, "?": 2}
    for words, _ in table:
        for w in words:
            classes.setdefault(shape(w), len(classes))
    m, n, longest = len(LABELS), len(table), max(len(w) for w, _ in table)
    c = np.zeros((n, longest + 2), np.int64)
    y = np.zeros((n, longest), np.int64)
    lengths = np.array([len(w) for w, _ in table])
    for i, (words, tags) in enumerate(table):
        c[i, 1 : len(words) + 1] = [classes[shape(w)] for w in words]
        y[i, : len(words)] = tags
    # shapes outside spans that are seen once or twice stand for unseen ones
    count = np.bincount(c.ravel(), minlength=len(classes))
    c[:, 1:-1] = np.where((count[c[:, 1:-1]] <= 2) & (y == 0) & (c[:, 1:-1] > 2), 2, c[:, 1:-1])
    only = _only_o(c)
    barred = np.zeros((m, m), bool)
    for a in range(m):
        for b in range(m):
            if LABELS[b][0] == "I" and LABELS[a][2:] != LABELS[b][2:]:
                barred[a, b] = True
    mask = np.arange(longest) < lengths[:, None]
    k = len(classes)
    p = {"here": np.zeros((k, m)), "before": np.zeros((k, m)), "after": np.zeros((k, m)), "moves": np.zeros((m, m))}
    mean, var = {q: np.zeros_like(x) for q, x in p.items()}, {q: np.zeros_like(x) for q, x in p.items()}
    places = {"here": c[:, 1:-1], "before": c[:, :-2], "after": c[:, 2:]}
    gold = np.zeros((n, longest, m))
    np.put_along_axis(gold, y[:, :, None], 1.0, 2)
    gold *= mask[:, :, None]
    pairs = np.zeros((m, m))
    np.add.at(pairs, (np.zeros(n, int), y[:, 0]), 1)
    for t in range(1, longest):
        np.add.at(pairs, (y[mask[:, t], t - 1], y[mask[:, t], t]), 1)
    np.add.at(pairs, (y[np.arange(n), lengths - 1], 0), 1)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, epochs + 1):
        moves = np.where(barred, _BARRED, p["moves"])
        e = p["here"][places["here"]] + p["before"][places["before"]] + p["after"][places["after"]]
        e[only, 1:] = _BARRED
        f, b = np.zeros((n, longest, m)), np.zeros((n, longest, m))
        f[:, 0] = e[:, 0] + moves[0]
        for t in range(1, longest):
            f[:, t] = np.where(mask[:, t, None], lse(f[:, t - 1, :, None] + moves, 1) + e[:, t], f[:, t - 1])
        b[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], lse(moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), moves[:, 0])
        z = lse(f[:, -1] + moves[:, 0], 1)
        marginal = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
        got = np.zeros((m, m))
        got[0] += marginal[:, 0].sum(0)
        got[:, 0] += marginal[np.arange(n), lengths - 1].sum(0)
        for t in range(1, longest):
            x = np.exp(f[:, t - 1, :, None] + moves + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            got += x[mask[:, t]].sum(0)
        diff = gold - marginal
        grad = {"moves": np.where(barred, 0, pairs - got)}
        for q, at in places.items():
            grad[q] = np.zeros((k, m))
            np.add.at(grad[q], at[mask], diff[mask])
        for q in p:
            g = grad[q] - l2 * p[q]
            mean[q] = 0.9 * mean[q] + 0.1 * g
            var[q] = 0.99 * var[q] + 0.01 * g * g
            p[q] += rate * (mean[q] / (1 - 0.9**step)) / (np.sqrt(var[q] / (1 - 0.99**step)) + 1e-8)
    return CRF(classes, p["here"], p["before"], p["after"], np.where(barred, _BARRED, p["moves"]))


@functools.cache
def default_crf() -> CRF:
    return train_crf()


class Shapes(dict):
    """Shape classes of words, as a bounded memo."""

    def __init__(self, classes: dict[str, int], limit: int = 150_000):
        self.classes, self.limit = classes, limit

    def __missing__(self, word: bytes) -> int:
        got = self.classes.get(shape(word), 2)
        if len(self) < self.limit:
            self[word] = got
        return got


class Finder:
    """Decodes texts; one per task."""

    def __init__(self, crf: CRF):
        self.crf, self.shapes = crf, Shapes(crf.classes)

    def stretches(self, classes: np.ndarray) -> list[tuple[int, int]]:
        """Intervals of words that must be decoded together."""
        odd = np.flatnonzero(classes != 1)
        if not len(odd):
            return []
        # a plain word next to an odd one may be part of a span; the others part the stretches
        lo, hi = np.maximum(odd - 1, 0), np.minimum(odd + 2, len(classes))
        cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
        return list(zip(lo[np.concatenate([[0], cut])].tolist(), hi[np.concatenate([cut - 1, [len(hi) - 1]])].tolist()))

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Spans in words of each text: (first, end, kind)."""
        jobs, seqs = [], []
        for d, text in enumerate(texts):
            words = text.split()
            c = np.fromiter(map(self.shapes.__getitem__, words), np.int64, len(words))
            for a, b in self.stretches(c):
                left = c[a - 1] if a else 0
                right = c[b] if b < len(c) else 0
                jobs.append((d, a, b - a))
                seqs.append(np.concatenate([[left], c[a:b], [right]]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        order = sorted(range(len(jobs)), key=lambda j: jobs[j][2])
        k = 0
        while k < len(order):  # batches of like lengths, bounded in cells
            longest = jobs[order[k]][2]
            n = k
            while n < len(order) and n - k < 4096 and jobs[order[n]][2] <= max(8, 2 * longest) and (n - k + 1) * jobs[order[n]][2] <= max(1 << 17, jobs[order[n]][2]):
                n += 1
            n = max(n, k + 1)
            part = order[k:n]
            top = max(jobs[j][2] for j in part)
            c = np.zeros((len(part), top + 2), np.int64)
            for i, j in enumerate(part):
                c[i, : len(seqs[j])] = seqs[j]
            labels = self.crf.viterbi(c, np.array([jobs[j][2] for j in part]))
            for i in np.flatnonzero(labels.any(1)):
                d, a, size = jobs[part[i]]
                row, t = labels[i], 0
                while t < size:
                    if row[t]:
                        kind, e = (int(row[t]) - 1) // 2, t + 1
                        while e < size and row[e] == 2 * kind + 2:
                            e += 1
                        out[d].append((a + t, a + e, kind))
                        t = e
                    else:
                        t += 1
            k = n
        for found in out:
            found.sort()
        return out


def find(finder: Finder, texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, in code points."""
    out = []
    for raw, found in zip(texts, finder.spans(texts)):
        if not found and not _MAYBE.search(raw):
            out.append(([], []))
            continue
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        added = []
        if found:
            at = [(m.start(), m.end()) for m in _TOKEN.finditer(raw)]
            # base spans by start, with the farthest end so far
            starts, ends, top = [s for s, _, _ in base], [], 0
            for _, e, _ in base:
                ends.append(top := max(top, e))
            byte = point = 0  # how far code points are counted
            for a, b, kind in found:
                first, last = at[a][0], at[b - 1][1]
                while raw[last - 1] in _EDGE and last - 1 > first:
                    last -= 1
                while raw[first] in _EDGE and first + 1 < last:
                    first += 1
                s = point + len(raw[byte:first].decode("utf-8", "replace"))
                e = s + len(raw[first:last].decode("utf-8", "replace"))
                byte, point = last, e
                n = bisect.bisect_left(starts, e)
                if (not n or ends[n - 1] <= s) and plausible(text[s:e], kind):
                    added.append((s, e, kind))
        out.append((base, sorted(base + added)))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def find_pii(docs: DataFrame, crf: CRF | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; no shuffle."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(crf or default_crf())

    def run(batches):
        finder = Finder(sent.value)
        for whole in batches:
            for b in slices(whole, "text"):
                got = find(finder, text_bytes(b.column(1)))
                counts = [pa.array([sum(k == q for _, _, k in base) for base, _ in got], pa.int64()) for q in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]), pa.array([joined(every) for _, every in got])],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, crf: CRF | None = None) -> DataFrame:
    """The rows of ``docs`` (same columns) with each span replaced by its kind, as in <EMAIL>.

    ``n_chars``, where there is one, follows the new text.  Overlapping spans become one."""
    sent = docs.sparkSession.sparkContext.broadcast(crf or default_crf())
    schema, names = docs.schema, docs.columns

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        for s, e, k in spans:
            if s >= end:
                out += [text[end:s], f"<{KINDS[k].upper()}>"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        finder = Finder(sent.value)
        for whole in batches:
            for b in slices(whole, "text"):
                place = b.schema.get_field_index("text")
                texts = b.column(place).to_pylist()
                got = find(finder, text_bytes(b.column(place)))
                new = [clean(t, every) if every else t for t, (_, every) in zip(texts, got)]
                columns = list(b.columns)
                columns[place] = pa.array(new, b.schema.field(place).type)
                if "n_chars" in names:
                    k = b.schema.get_field_index("n_chars")
                    old = columns[k].to_pylist()
                    columns[k] = pa.array([len(n) if every else o for n, o, (_, every) in zip(new, old, got)], b.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(tidy(run), schema)
