"""Piece vocabularies with byte fallback: pre-tokens, exact encoding over a trie, decoding.

The model is read through the sentencepiece library (pieces, scores); it must be of the merging
kind with identity normalisation, a dummy prefix and white space kept, and no piece may hold a
word mark behind another character.  Then nothing ever merges across

* a mark that follows another character, or
* a character without a piece, such as the line feed,

so a text falls apart into pre-tokens (``PRETOKEN``) that can be encoded one by one.

Shared-prefix Viterbi.  For merging vocabularies the segmentation that the merges give is the only
one in which each pair of neighbours stays apart when merged alone.  So the forward pass over a
word keeps, for each prefix, the last piece of the prefix's own segmentation and its length in
pieces (the forward score): the last piece is the one that fits the state of the shorter prefix.
That state depends on the prefix alone: distinct words are sorted, which lays them out as a trie
in depth-first order, and each word takes over the states of the prefix it shares with the one
before.  Additive scores, as in the usual Viterbi over unigram models, would give other pieces
than the library for such a vocabulary; the fit of neighbours takes their place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"
_MARK_BYTES = MARK.encode()
#: Marks (as spaces) with what follows, or a line feed with what follows.
PRETOKEN = re.compile(rb" +[^ \n]*|\n[^ \n]*")


def pretokens(text: bytes) -> list[bytes]:
    """Pre-tokens of a UTF-8 text; their concatenation is the text behind its dummy prefix."""
    if not text:
        return []
    if _MARK_BYTES in text:
        text = text.replace(_MARK_BYTES, b" ")
    return PRETOKEN.findall(b" " + text)


class Library:
    """Numbers of tokens of pre-tokens, by the sentencepiece library itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, units: list[bytes]) -> list[int]:
        """A unit that starts with a mark is given without it: the library puts it back.  One that
        starts with a line feed gets a mark too many, which is one token."""
        texts = [(u[1:] if u[0] == 32 else u).decode("utf-8", "replace") for u in units]
        # the library adds no prefix to an empty text, but a lone mark is a token
        got = [len(x) if t else 1 for x, t in zip(self.model.encode(texts, num_threads=1) if texts else [], texts)]
        return [n - (u[0] == 10) for n, u in zip(got, units)]


@dataclass
class Vocabulary:
    """Pieces, merges and their tries' states; one per worker."""

    path: str
    limit: int = 200_000
    ids: dict[str, int] = field(init=False, repr=False)
    done: dict[bytes, tuple[int, ...]] = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = m.get_piece_size()
        self.ids, self.rank, self.out, self.bytes = {}, {}, [b""] * n, {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.out[i] = bytes([value])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, m.get_score(i)
                self.out[i] = piece.replace(MARK, " ").encode()
        self.names = {i: p for p, i in self.ids.items()}
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        #: By the last two characters: lengths of the pieces that end so, longest first.
        self.lengths = {k: tuple(sorted(x, reverse=True)) for k, x in lengths.items()}
        self.fits: dict[int, bool] = {}

    # -- merging by definition, of two pieces at a time: what fits rests on
    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.rank.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, key: int, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        got = self.merge(a + b) == [a, b]
        if len(self.fits) > 250_000:
            self.fits.clear()
        self.fits[key] = got
        return got

    def encode_sorted(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of sorted distinct words, depth-first over their trie."""
        ids, fits, lengths, fit = self.ids, self.fits, self.lengths, self._fit
        before, last, size, out = "", [-1], [0], []
        for word in words:
            k, top = 0, min(len(word), len(before))
            while k < top and word[k] == before[k]:
                k += 1
            del last[k + 1 :], size[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                for n in lengths.get(word[end - 2 : end], ()) if end > 1 else ():
                    if n > end:
                        continue
                    piece = ids.get(word[end - n : end])
                    if piece is None:
                        continue
                    left = last[end - n]
                    if left >= 0:
                        key = left << 16 | piece
                        ok = fits.get(key)
                        if ok is None:
                            ok = fit(key, left, piece)
                        if not ok:
                            continue
                    last.append(piece)
                    size.append(n)
                    break
                else:  # the character alone; one without a piece merges with nothing
                    c = word[end - 1]
                    last.append(ids.get(c, -2 - ord(c)))
                    size.append(1)
            before, at, got = word, len(word), []
            while at:
                piece = last[at]
                if piece >= 0:
                    got.append(piece)
                else:
                    got.extend(self.bytes[x] for x in reversed(chr(-2 - piece).encode()))
                at -= size[at]
            got.reverse()
            out.append(tuple(got))
        return out

    def units(self, wanted: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of pre-tokens that aren't in the bounded memo, which takes them up while it has room."""
        words = sorted((u.decode("utf-8", "replace").replace(" ", MARK), u) for u in wanted)
        new = dict(zip((u for _, u in words), self.encode_sorted([w for w, _ in words])))
        for u, got in new.items():
            if len(self.done) >= self.limit:
                break
            self.done[u] = got
        return new

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        cut = [pretokens(t) for t in texts]
        wanted = set().union(*cut) - self.done.keys() if cut else set()
        new = self.units(wanted)
        done, out = self.done, []
        for units in cut:
            row: list[int] = []
            for u in units:
                row.extend(done[u] if u in done else new[u])
            out.append(row)
        return out

    def decode(self, ids) -> bytes:
        """The text: pieces joined, marks as spaces, without the dummy prefix."""
        out = self.out
        return b"".join([out[i] for i in ids])[1:]
