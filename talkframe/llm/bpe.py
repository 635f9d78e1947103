"""Byte-level BPE as a lazily determinised finite-state transducer.

Merging by rank has one outcome per byte string, and it can be read off from left to right: a
sequence of tokens is the outcome exactly if each two neighbours, merged on their own, stay as
they are. So the outcome for every prefix has a last token, and the outcome for the whole is the
chain of last tokens. The transducer follows, byte by byte, only those starts from which a token
may still grow (a path in the trie of the vocabulary). The set of open starts, each with its trie
node and the last token before it, is a state; the step of a state on a byte is worked out once
and kept. What all open chains share is final and can be emitted: lookahead is bounded by the
longest token.

Texts are cut by the split pattern as the installed Unicode tables class characters; code points
that a newer Unicode version assigned may fall in another piece than with other tables.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from itertools import islice

# states and pairs kept before their table starts anew (bounds on memory, not on texts)
MAX_STATES = 1 << 17
MAX_PAIRS = 1 << 19
# bytes after which what is already final is emitted
FLUSH = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings to token ids and back, by the ranks given."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        # one object per id, shared by all pieces that are kept
        self.ids = list(range(max(ranks.values()) + 1))
        # trie: node -> {byte: node}; node -> id of the token that ends there
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, r in ranks.items():
            at = 0
            for b in t:
                if b not in self.kids[at]:
                    self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                at = self.kids[at][b]
            self.ends[at] = r
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # a state is a tuple of open starts, oldest first: (trie node, last token before it)
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        # state * 256 + byte -> next state << 32 | last token
        self.steps: dict[int, int] = {}
        self.start = self._number(((0, -1),))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for bytes and for tokens that merging
        doesn't reach."""
        if token not in self.splits:
            data = self.token[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def _reached(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self._split(token) is not None

    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens that stand at one end (0 left, 1 right) while a token is merged, first to last."""
        found = self.edges.get((token, side))
        if found is None:
            found, at = [token], token
            while (split := self._split(at)) is not None:
                at = split[side]
                found.append(at)
            found.reverse()
            self.edges[(token, side)] = found
        return found

    def _stays(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side are the outcome for their bytes: while each is merged
        in the order of ranks, no merge over the border may come first."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = self._reached(b)
            if known and a >= 0:
                xs, ys, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
                never = 1 << 60
                while True:
                    over = self.ranks.get(self.token[xs[i]] + self.token[ys[j]], never)
                    left = xs[i + 1] if i + 1 < len(xs) else never
                    right = ys[j + 1] if j + 1 < len(ys) else never
                    # of equal ranks the leftmost merge comes first
                    if over < left and over <= right and over < never:
                        known = False
                        break
                    if left == right == never:
                        break
                    if left <= right:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def _step(self, number: int, byte: int) -> int:
        """The step of a state on a byte, worked out and kept."""
        grown, last = [], -1
        kids, ends = self.kids, self.ends
        for node, before in self.states[number]:
            node = kids[node].get(byte)
            if node is not None:
                if kids[node]:
                    grown.append((node, before))
                t = ends[node]
                # the one start whose token goes with the token before it
                if t >= 0 and last < 0 and self._stays(before, t):
                    last = t
        if last < 0:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")
        if len(self.states) >= MAX_STATES:
            self._clear()
            return self._number((*grown, (0, last))) << 32 | last
        grown.append((0, last))
        found = self.steps[number << 8 | byte] = self._number(tuple(grown)) << 32 | last
        return found

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to ``end``, by the last token at each byte."""
        out, token, ids = [], self.token, self.ids
        while end:
            t = ids[lasts[end - 1]]
            out.append(t)
            end -= len(token[t])
        out.reverse()
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Token ids of one piece of bytes, emitted once they are final."""
        lasts: list[int] = []  # last token at each byte since the last emission
        at = self.start
        for begin in range(0, len(data), FLUSH):
            for byte in data[begin:begin + FLUSH]:
                step = self.steps.get(at << 8 | byte)
                if step is None:
                    step = self._step(at, byte)
                at = step >> 32
                lasts.append(step & 0xFFFFFFFF)
            # every open start lies within the longest token: what the chains up to there share
            # is final
            n = len(lasts)
            chains = [self._chain(lasts, end) for end in range(max(1, n - self.longest), n + 1)]
            common = 0
            while all(len(c) > common and c[common] == chains[0][common] for c in chains):
                common += 1
            final = chains[0][:common]
            yield from final
            del lasts[:sum(len(self.token[t]) for t in final)]
        yield from self._chain(lasts, len(lasts))

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece of bytes."""
        if len(data) > FLUSH:
            return list(self.stream(data))
        lasts, at, kept = [], self.start, self.steps.get
        for byte in data:
            step = kept(at << 8 | byte)
            if step is None:
                step = self._step(at, byte)
                kept = self.steps.get
            at = step >> 32
            lasts.append(step & 0xFFFFFFFF)
        return self._chain(lasts, len(lasts))


# texts below this code point are split by the standard library, which is several times faster
LATIN = 0x250


def _splitter(pattern: str, fast: bool):
    """The split pattern compiled with Unicode's white space and, for ``fast``, with the
    properties spelt out for code points below LATIN."""
    import re

    import regex
    names = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}
    if not fast:
        return regex.compile(re.sub(r"\\[sS]", lambda m: names[m[0]], pattern)).findall
    below = "".join(map(chr, range(LATIN)))

    def members(prop: str) -> str:
        prop = names.get(prop, prop)
        return "".join(re.escape(c) for c in regex.findall(prop.replace(r"\P", r"\p"), below))

    out, in_set, at = [], False, 0
    for m in re.finditer(r"\\[pP]\{\w+\}|\\[sS]|\\.|\[|\]", pattern):
        out.append(pattern[at:m.start()])
        at = m.end()
        if m[0] in "[]":
            in_set = m[0] == "["
            out.append(m[0])
        elif m[0][:2] in (r"\p", r"\s"):
            out.append(members(m[0]) if in_set else f"[{members(m[0])}]")
        elif m[0][:2] in (r"\P", r"\S") and not in_set:
            out.append(f"[^{members(m[0])}]")
        else:
            out.append(m[0])
    return re.compile("".join(out) + pattern[at:]).findall


class Encoder:
    """Encodes texts: pieces of the split pattern, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 1 << 18):
        self.fst = Transducer(ranks)
        self.split = _splitter(pattern, False)
        self.split_latin = _splitter(pattern, True)
        self.names = [str(i) for i in self.fst.ids]
        self.max_pieces = max_pieces
        # ids of pieces, in two generations: a full one becomes the older one, which lookups still find
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.fst.ranks.get(raw)
            found = (self.fst.ids[whole],) if whole is not None else tuple(self.fst.encode(raw))
        if len(self.pieces) >= self.max_pieces:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        out: list[int] = []
        kept = self.pieces
        for piece in (self.split_latin if max(text, default="") < chr(LATIN) else self.split)(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self._piece(piece)
                kept = self.pieces
            out += ids
        return out

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


# tokens that are put together before the state machine sees them
DECODE_BLOCK = 4096


def decode_stream(ids: Iterable[int], token: dict[int, bytes], errors: str = "strict") -> Iterator[str]:
    """Text of a stream of ids, block by block: an incremental UTF-8 state machine keeps the bytes
    of a character that only the next block ends. ``errors`` is as in bytes.decode."""
    machine = codecs.getincrementaldecoder("utf-8")(errors)
    ids = iter(ids)
    while block := list(islice(ids, DECODE_BLOCK)):
        if text := machine.decode(b"".join(map(token.__getitem__, block))):
            yield text
    if tail := machine.decode(b"", final=True):
        yield tail
