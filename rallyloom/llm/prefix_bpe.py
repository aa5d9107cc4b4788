"""Token counts of every prefix of a word, by dynamic programming over its bytes.

For a vocabulary of ranked merges, the encoding of a prefix is the encoding of a
shorter prefix and one more token, and that token is the only one that ends here and
whose border with the token before it no merge crosses. So with C[0] = 0,

    C[k] = C[j] + 1, last[k] = t,   t = bytes j..k, border(last[j], t) holds,

where j is found among the few tokens that end at k. A border holds if, while both
sides grow by their own merges in the order of ranks, no merge of the two symbols
that touch there is due before the next merge on either side. Nothing is encoded
twice, and a word of any length takes a few look-ups and three numbers a byte.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

#: Suffixes after an apostrophe that are one piece with it, and the characters that separate pieces.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
NEVER = 1 << 60


@cache
def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@cache
def _joins_back() -> frozenset[str]:
    """Characters that may compose with what stands before them."""
    seconds = set()
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


def starts_afresh(c: str) -> bool:
    """Whether what stands before the character is normalised without a look at it."""
    return c < "̀" or (not unicodedata.combining(c) and c not in _joins_back())


class Merges:
    """Ranked merges of a tokenizers file whose words end in a suffix symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed([*enumerate(pairs)])}
        self.vocabulary = set(model["vocab"])
        self.special = tuple(t["content"] for t in whole["added_tokens"])
        tails = {t[i:] for t in self.vocabulary for i in range(len(t))}
        self.tails = tails
        self.borders: dict[tuple[str, str], bool] = {}

    def _climb(self, token: str, side: int) -> list[tuple[int, str]]:
        """The symbols at one edge of a token as it grows: (rank at which it appears, symbol)."""
        out = []
        while token in self.made:
            rank, *parts = self.made[token]
            out.append((rank, token))
            token = parts[side]
        return [(-1, token), *reversed(out)]

    def border(self, left: str, right: str) -> bool:
        """Whether a text of these two tokens stays these two tokens."""
        known = self.borders.get((left, right))
        if known is None:
            if len(self.borders) > 2_000_000:
                self.borders.clear()
            a, b = self._climb(left, 1), self._climb(right, 0)
            i = j = 0
            known = True
            while True:
                grow_a = a[i + 1][0] if i + 1 < len(a) else NEVER
                grow_b = b[j + 1][0] if j + 1 < len(b) else NEVER
                across = self.rank.get((a[i][1], b[j][1]), NEVER)
                # Of equal ranks the leftmost merge is first: left, across, right.
                if across < grow_a and across <= grow_b and across != NEVER:
                    known = False
                    break
                if grow_a == grow_b == NEVER:
                    break
                if grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            self.borders[left, right] = known
        return known


class _Piece:
    """C and last of one piece; bytes can be added and taken back."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.letters: list[str] = []
        self.count, self.last = [0], [""]

    def _ends_here(self, suffix: str) -> tuple[int, str]:
        token, k = suffix, len(self.letters)
        for j in range(k - 1, -1, -1):
            token = self.letters[j] + token
            if token not in self.merges.tails:
                break
            if token in self.merges.vocabulary and (j == 0 or self.merges.border(self.last[j], token)):
                return self.count[j] + 1, token
        raise LookupError(token)

    def add(self, char: str) -> None:
        letters = byte_letters()
        for byte in char.encode():
            self.letters.append(letters[byte])
            count, token = self._ends_here("")
            self.count.append(count)
            self.last.append(token)

    def ended(self) -> int:
        """Tokens of the piece if it ends here."""
        return self._ends_here(self.merges.end)[0] if self.letters else 0

    def cut(self, size: int) -> None:
        del self.letters[size:], self.count[size + 1 :], self.last[size + 1 :]


class _Reader:
    """Reads normalised characters, splits them into pieces, and knows the tokens so far.

    Pieces are contractions, runs of letters, single numerals, and runs of what is
    neither letter, numeral nor white space.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.done, self.kind, self.piece, self.after = 0, "", _Piece(merges), ""

    def _close(self) -> None:
        self.done += self.piece.ended()
        self.kind, self.piece = "", _Piece(self.merges)

    def _open(self, kind: str, char: str) -> None:
        self.kind = kind
        self.piece.add(char)

    def read(self, char: str) -> None:
        category = unicodedata.category(char)[0]
        kind = "space" if char in WHITE else "letter" if category == "L" else "numeral" if category == "N" else "other"
        if self.kind == "apostrophe":  # it began a piece; self.after is what follows it
            if self.after + char in CONTRACTIONS:
                for c in self.after + char:
                    self.piece.add(c)
                self.after = ""
                return self._close()
            if not self.after and any(c.startswith(char) for c in CONTRACTIONS):
                self.after = char
                return None
            if self.after:
                self._close()
                self._open("letter", self.after)
                self.after = ""
            else:
                self.kind = "other"
        if self.kind and kind != self.kind:
            self._close()
        if kind == "numeral":
            self._open(kind, char)
            self._close()
        elif kind != "space":
            self._open("apostrophe" if char == "'" and not self.kind else kind, char)

    def tokens(self) -> int:
        if self.after:  # an apostrophe and a first letter: two pieces until the second letter comes
            letter = _Piece(self.merges)
            letter.add(self.after)
            return self.done + self.piece.ended() + letter.ended()
        return self.done + self.piece.ended()

    def mark(self) -> tuple:
        return self.done, self.kind, self.piece, len(self.piece.letters), self.after

    def back(self, mark: tuple) -> None:
        self.done, self.kind, self.piece, size, self.after = mark
        self.piece.cut(size)


def _plain(merges: Merges, text: str) -> list[int]:
    """Tokens of each prefix, special strings aside."""
    reader, out = _Reader(merges), []
    if unicodedata.is_normalized("NFC", text):  # then so is every prefix
        for c in text:
            for x in c.lower():
                reader.read(x)
            out.append(reader.tokens())
        return out
    mark, held = reader.mark(), ""
    for c in text:
        if starts_afresh(c):
            mark, held = reader.mark(), ""
        held += c
        reader.back(mark)
        for x in unicodedata.normalize("NFC", held):
            for y in x.lower():
                reader.read(y)
        out.append(reader.tokens())
    return out


def prefix_counts_of_word(merges: Merges, word: str) -> list[int]:
    """Tokens of the word's first 0, 1, 2, ... code points."""
    out, start = [0], 0
    while True:
        found = min(((word.find(s, start), s) for s in merges.special if word.find(s, start) >= 0), default=None)
        stop = found[0] + len(found[1]) if found else len(word)
        base = out[-1]
        out += [base + n for n in _plain(merges, word[start:stop])]
        if not found:
            return out
        out[-1] = out[found[0]] + 1  # the special string is complete
        start = stop
