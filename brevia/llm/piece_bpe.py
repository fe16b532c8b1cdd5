"""SentencePiece BPE encoding by a prefix table, and decoding by a piece table.

BPE with a fixed priority per piece has two properties that make a table over
prefixes enough. A sequence of tokens is the encoding of its text exactly when every
neighbouring pair is the encoding of the pair's text, since the first merge that
crosses a border depends on the two tokens beside that border alone. So each prefix
of a text has one last token, the only vocabulary match that ends there, starts where
another prefix ends, and is compatible with that prefix's last token. The automaton
gives the matches that end at each place, the pair test decides between them, and the
ids are read from the table backwards.

Texts are cut into units first: no piece has white space after other characters, and
none joins a newline to anything, so no merge crosses these borders (checked when the
model is loaded; a model that breaks a rule is refused). Encoded units are kept in a
bounded cache, which a task gives back when it ends.
"""

from __future__ import annotations

import re
from functools import cached_property

import ahocorasick
import sentencepiece

#: SentencePiece writes a space as MARK and takes a MARK in a text for a space. Here both are spaces: one byte a character.
MARK, SPACE = "▁", " "
#: Rank of a merge that never happens.
NEVER = float("inf")


class Model:
    """Vocabulary of a SentencePiece BPE model with byte fallback, begin and end ids."""

    def __init__(self, blob: bytes, cached_units: int = 100_000, cached_pairs: int = 150_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = sp.get_piece_size()
        self.bos, self.eos, self.cached_pairs = sp.bos_id(), sp.eos_id(), cached_pairs
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.pieces = [None if i in special else sp.id_to_piece(i).replace(MARK, SPACE) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if p}
        self.singles = frozenset(p for p in self.ids if len(p) == 1)
        #: Merges happen in the order of score, highest first, then from the left.
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self._check(sp, special)
        surface = [(p or "").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface = surface
        self.units = self._units()
        self.code = [i.to_bytes(4, "little") for i in range(n)]
        self.unit_ids = _UnitCache(self.encode_unit, cached_units)
        self._pairs: dict[int, bool] = {}
        self._traces: dict[int, tuple | None] = {}

    def _check(self, sp, special: set[int]) -> None:
        multi = [p for p in self.ids if len(p) > 1]
        if any(not sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in multi):
            raise ValueError("a piece crosses the border of a unit")
        if any(c not in self.ids for p in multi for c in p):
            raise ValueError("a piece holds a character that is no piece")
        for probe in ("a", " a  b ", "Ａ ﬁ́", "\t\n "):
            if sp.decode(sp.encode(probe)) != probe or sp.encode(probe, out_type=str)[0][:1] != MARK:
                raise ValueError("the model normalises texts or adds no space before them")

    def _units(self) -> re.Pattern:
        """A unit also ends with its letters, unless what follows is joined to a letter in some piece."""
        letter, other = r"[^\W\d_]", rf"(?:[^{SPACE}\n\w]|[\d_])"
        joined = sorted({b for p in self.ids for a, b in zip(p, p[1:]) if re.match(letter, a) and not re.match(letter, b)})
        ends = f"(?![{re.escape(''.join(joined))}])" if joined else ""
        return re.compile(f"{SPACE}*+{letter}++{ends}|\n|{SPACE}*+{other}++{letter}*+{ends}|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            found.add_word(p, (len(p), i))
        found.make_automaton()
        return found

    def merges(self, text: str):
        """BPE of a short text by its definition: the best-ranked neighbours merge, leftmost first.

        Gives (rank of the next merge, parts before it); a rank of infinity when nothing merges any more.
        """
        parts, rank = list(text), self.rank
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], NEVER)
                if r < best:
                    best, at = r, k
            yield best, parts
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged(self, text: str) -> list[int]:
        for _, parts in self.merges(text):
            pass
        return [self.ids[p] for p in parts]

    def trace(self, a: int) -> tuple[list[float], list[str], list[str]] | None:
        """Ranks of the merges that make token a, and its first and last part before each; None if its text encodes otherwise."""
        if a not in self._traces:
            steps = [(r, parts[0], parts[-1], len(parts)) for r, parts in self.merges(self.pieces[a])]
            self._traces[a] = None if steps[-1][3] > 1 else tuple(map(list, list(zip(*steps))[:3]))
        return self._traces[a]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b encodes as a, b.

        Both sides go through the merges of their own traces, the better rank first and the
        left one of equals, as long as no merge over the border is due before.
        """
        key = a * len(self.pieces) + b
        known = self._pairs.get(key)
        if known is None:
            known = self._apart(self.trace(a), self.trace(b))
            if len(self._pairs) >= self.cached_pairs:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _apart(self, a, b) -> bool:
        if a is None or b is None:
            return False
        (left, _, ends), (right, starts, _), rank = a, b, self.rank
        i = j = 0
        while True:
            over = rank.get(ends[i] + starts[j], NEVER)
            x, y = left[i], right[j]
            if over < x and over <= y:
                return False
            if x == NEVER and y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def reachable(self, a: int) -> bool:
        """Whether the text of token a encodes as a alone."""
        return self.trace(a) is not None

    def release(self) -> None:
        """Gives the caches back."""
        self.unit_ids.clear()
        self.unit_ids.old = {}
        self._pairs.clear()

    def encode_unit(self, unit: str) -> bytes:
        """Ids of one unit as little-endian unsigned 32-bit integers."""
        ids = self.ids
        last = [-1] * (len(unit) + 1)  # -1: none yet; -2: a token may start here whatever came before
        last[0] = -2
        if not self.singles.issuperset(unit):
            for k, c in enumerate(unit):
                if c not in ids:  # written as bytes, and no merge reaches over it
                    last[k + 1] = -2
        pairs, size = self._pairs, len(self.pieces)
        for end, (length, token) in self.automaton.iter(unit):
            if last[end + 1] != -1:
                continue
            before = last[end + 1 - length]
            if before >= 0:
                known = pairs.get(before * size + token)
                if self.compatible(before, token) if known is None else known:
                    last[end + 1] = token
            elif before == -1:
                continue
            elif self.reachable(token):
                last[end + 1] = token
        out, at = [], len(unit)
        while at:
            token = last[at]
            if token >= 0:
                out.append(self.code[token])
                at -= len(self.pieces[token])
            else:
                if token == -1:
                    raise AssertionError(f"no token ends at {at} of {unit[:80]!r}")
                at -= 1
                out.extend(self.code[self.byte_ids[b]] for b in reversed(unit[at].encode()))
        return b"".join(reversed(out))

    def split(self, text: str) -> list[str]:
        """Units of a text, with the space that the model puts before it; none for an empty text."""
        return self.units.findall(SPACE + text.replace(MARK, SPACE)) if text else []

    def encode(self, text: str, add_bos: bool = True, add_eos: bool = True) -> bytes:
        body = b"".join(map(self.unit_ids.__getitem__, self.split(text)))
        return (self.code[self.bos] if add_bos else b"") + body + (self.code[self.eos] if add_eos else b"")

    def decode(self, ids) -> bytes:
        """UTF-8 of the text; control ids give nothing, bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.surface.__getitem__, ids))
        for i in ids:  # the space before the text goes if the first piece has it
            if i != self.bos and i != self.eos:
                if self.pieces[i] and self.pieces[i].startswith(SPACE):
                    out = out[1:]
                break
        return out


class _UnitCache(dict):
    """Two generations of encoded units; the older one goes when the younger is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, unit: str) -> bytes:
        value = self.old.get(unit)
        if value is None:
            value = self.encode(unit)
        if len(unit) <= 64:  # long units are rare and would fill the cache
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = value
        return value


_loaded: dict[int, Model] = {}


def load(blob: bytes) -> Model:
    """One model per worker process; a task releases its caches when it ends."""
    key = hash(blob)
    if key not in _loaded:
        _loaded[key] = Model(blob)
    return _loaded[key]
