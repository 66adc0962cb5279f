"""Byte-pair encodings as finite-state machines that read left to right.

Base fact: pieces t1 .. tn are the encoding of their concatenation exactly if each neighbouring pair (ti, ti+1) is
the encoding of its own concatenation. Merges have a total order, by rank and then place; as long as no merge crosses
a boundary, the merges on its two sides run as they would with only the two pieces beside it, so the first merge to
cross one would also happen in that pair alone. So each prefix of a text has one last piece: the one that may follow
the last piece of the prefix before it. What comes next depends on the last pieces at those earlier places from which
a piece of the vocabulary could still reach further, a window no longer than the longest piece.
"""

from __future__ import annotations

START = -1


class Kept:
    """Results by key in two generations: when the newer is full it becomes the older, so what recurs stays."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def find(self, key):
        if (x := self.new.get(key)) is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old = dict(self.new)
            self.new.clear()  # in place: callers hold its ``get``
        self.new[key] = value


class Pairs:
    """Which piece may stand after which, for symbols ``str`` or ``bytes``.

    rank(a, b): order of the merge that joins symbols a and b, or None. Pieces are those in ``ids``.
    """

    def __init__(self, ids: dict, rank):
        self.ids, self.rank, self.names = ids, rank, {i: p for p, i in ids.items()}
        self.longest = max(map(len, ids), default=1)
        self.known: dict[tuple[int, int], bool] = {}

    def merge(self, text) -> list:
        """The encoding by merging, for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand right after piece a (START: at the start)."""
        key = (a, b)
        if (ok := self.known.get(key)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            right = self.names[b]
            if a == START:
                ok = self.merge(right) == [right]
            else:
                left = self.names[a]
                ok = self.merge(left + right) == [left, right]
            self.known[key] = ok
        return ok


class CountMachine:
    """Deterministic transducer over bytes, built as it is used; transitions carry the change in the token count.

    A state is what later steps depend on: the longest suffix read that is a proper prefix of a piece, and for each
    place in it the last piece there and its count, relative to the count at the end.
    """

    def __init__(self, pairs: Pairs, most_states: int = 400_000):
        self.pairs, self.most = pairs, most_states
        self.prefixes = {p[:i] for p in pairs.ids for i in range(len(p))}
        self._reset()

    def _reset(self) -> None:
        self.states = [(b"", (START,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        text, last, rel = self.states[state]
        text += bytes((byte,))
        for n in range(len(text), 0, -1):
            piece = self.pairs.ids.get(text[-n:])
            if piece is not None and (n <= len(last)) and self.pairs.follows(last[-n], piece):
                break
        else:
            raise ValueError(f"no piece ends in byte {byte}")
        delta = rel[-n] + 1
        last, rel = (*last, piece), (*(x - delta for x in rel), 0)
        keep = len(text)
        while text[len(text) - keep :] not in self.prefixes:
            keep -= 1
        made = (text[len(text) - keep :], last[-keep - 1 :], rel[-keep - 1 :])
        if (number := self.numbers.get(made)) is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
            self.steps.append({})
        self.steps[state][byte] = number, delta
        return number, delta

    def count(self, data: bytes) -> int:
        """How many tokens the encoding of ``data`` has."""
        if len(self.states) > self.most:
            self._reset()
        state, total, steps = 0, 0, self.steps
        for byte in data:
            state, delta = steps[state].get(byte) or self._step(state, byte)
            total += delta
        return total


class StreamCoder:
    """Viterbi over symbols with a bounded window; commits when all surviving paths run through one boundary.

    Each place has one best path, the only admissible one, kept as its last piece. Survivors are the places from
    which a piece can still reach further, and the end: the state, built as it is used, has their last pieces and the
    symbols since the first of them. Ids are committed up to the last boundary that the paths of all survivors share,
    and places before it are dropped; so no more are held than ``HELD`` times the longest piece.
    """

    HELD = 4

    def __init__(self, pairs: Pairs, unknown, most_states: int = 200_000):
        self.pairs, self.unknown, self.most = pairs, unknown, most_states
        self.prefixes = {p[:i] for p in pairs.ids for i in range(len(p))}
        self.widest = 0  # places held at most so far
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.steps = [("", (START,))], {("", (START,)): 0}, [{}]

    def _step(self, state: int, symbol: str) -> tuple[int, int, int]:
        """(next state, last piece, its length); a negative piece stands for an unknown symbol."""
        text, last = self.states[state]
        text += symbol
        for n in range(len(text), 0, -1):
            piece = self.pairs.ids.get(text[-n:])
            if piece is not None and self.pairs.follows(last[-n], piece):
                last = (*last, piece)
                break
        else:  # nothing joins an unknown symbol, so it is like a start
            text, last, piece, n = "", (START,), -2 - ord(symbol), 1
        keep = len(text)
        while text[len(text) - keep :] not in self.prefixes:
            keep -= 1
        made = (text[len(text) - keep :], last[-keep - 1 :])
        if (number := self.numbers.get(made)) is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
            self.steps.append({})
        out = self.steps[state][symbol] = (number, piece, n)
        return out

    def encode(self, text: str) -> list[int]:
        if len(self.states) > self.most:
            self._reset()
        steps, slow, most = self.steps, self._step, self.HELD * self.pairs.longest
        out: list[int] = []
        path: list[tuple[int, int, int]] = []
        state = 0
        for symbol in text:
            step = steps[state].get(symbol) or slow(state, symbol)
            path.append(step)
            state = step[0]
            if len(path) >= most:
                self.widest = max(self.widest, len(path))
                self._commit(path, self._shared(path, len(self.states[state][0])), out)
        self.widest = max(self.widest, len(path))
        self._commit(path, len(path), out)
        return out

    @staticmethod
    def _shared(path: list, window: int) -> int:
        """The last boundary on the paths of all survivors, those of the last ``window`` places and the end."""
        heads = set(range(max(0, len(path) - window), len(path) + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - path[top - 1][2])
        return heads.pop()

    def _commit(self, path: list, upto: int, out: list[int]) -> None:
        ids, at = [], upto
        while at > 0:
            _, piece, n = path[at - 1]
            ids.append(piece)
            at -= n
        ids.reverse()
        if min(ids, default=0) < 0:
            for piece in ids:
                out.extend((piece,) if piece >= 0 else self.unknown(chr(-2 - piece)))
        else:
            out += ids
        del path[:upto]
