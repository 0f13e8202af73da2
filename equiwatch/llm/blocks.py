"""Cheapest edits of a message sequence by Four-Russians block tables.

A sequence is a row of symbols: a role's initial (``s``, ``u``, ``a`` or another),
whether the message is cut short, or that it has to go.  Edits turn it into
``(s?(ua)+)?``: keep 0, new role 1, delete 2, insert an empty message 5; a message
cut short adds 5 unless it is deleted.

The state is what was written last (nothing, s, u, a), so a position has a vector
of four costs.  Less its minimum, and without costs over ``LIMIT``, such a vector is
one of a small number; for each of them and every block of ``BLOCK`` symbols a
table holds the vector after the block and what the minimum grows by.  A sequence
is walked by one lookup a block.  For the edits, blocks are expanded again from the
last to the first, and every state on a cheapest path is marked, ties included;
then the least initials that stay on marked states are read from the front.

All tables follow from the rules above.
"""

from __future__ import annotations

import numpy as np

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: States: nothing written, or the initial written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a message whose role may be chosen.
THEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) -> state after a message kept.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NOTHING, ASSISTANT)
INITIALS = "sua"
#: Symbols: 2 * initial + cut short (initial 3: another role), and one that must go.
MUST_GO, SYMBOLS = 8, 9
BLOCK = 3
NEVER = 1 << 20
#: A state can take up any other's plan after two inserts and one deletion.
LIMIT = 2 * INSERT + DELETE


def symbol(initial: str, cut_short: bool, must_go: bool) -> int:
    if must_go:
        return MUST_GO
    place = INITIALS.find(initial) if len(initial) == 1 else -1
    return 2 * (place if place >= 0 else 3) + cut_short


def edges(state: int, sym: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a message, ASCII-least first."""
    out = [("D", DELETE, state)]
    if sym != MUST_GO:
        extra = CUT_SHORT * (sym & 1)
        kept = KEPT.get((state, INITIALS[sym >> 1])) if sym >> 1 < 3 else None
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, THEN[state]))
    return out


def _closed(vector: list[int]) -> list[int]:
    """With inserts: at most three follow each other before a state comes again."""
    for _ in range(3):
        for q in range(4):
            vector[THEN[q]] = min(vector[THEN[q]], vector[q] + INSERT)
    return vector


def _normal(vector: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(vector)
    return tuple(x - low if x - low <= LIMIT else NEVER for x in vector), low


def _step(vector: tuple[int, ...], sym: int) -> tuple[tuple[int, ...], int]:
    new = [NEVER] * 4
    for q, x in enumerate(vector):
        if x < NEVER:
            for _, cost, to in edges(q, sym):
                new[to] = min(new[to], x + cost)
    return _normal(_closed(new))


class BlockTable:
    """Vectors by number (0 is the first), and their successors after a symbol and after a block."""

    def __init__(self, block: int = BLOCK):
        first, _ = _normal(_closed([0, NEVER, NEVER, NEVER]))
        number, self.vectors = {first: 0}, [first]
        after, grows = [], []
        for vector in self.vectors:  # grows as new ones are found
            row = [_step(vector, sym) for sym in range(SYMBOLS)]
            for new, _ in row:
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
            after.append([number[new] for new, _ in row])
            grows.append([g for _, g in row])
        self.after, self.grows, self.block = after, grows, block
        self._before, self._read = {}, {}  # filled as they come up
        one, add = np.array(after), np.array(grows)
        to, total = one, add
        for _ in range(block - 1):
            total = (total[:, :, None] + add[to]).reshape(len(one), -1)
            to = one[to].reshape(len(one), -1)
        self.block_after, self.block_grows = to.tolist(), total.tolist()
        self.place = SYMBOLS ** np.arange(block - 1, -1, -1)

    def walk(self, symbols: bytes) -> tuple[list[int], int, int]:
        """Vectors where blocks begin, the vector after the last symbol, and the least cost of any state there."""
        whole = len(symbols) - len(symbols) % self.block
        codes = np.frombuffer(symbols, np.uint8, whole).reshape(-1, self.block) @ self.place
        at, cost, starts = 0, 0, []
        for code in codes.tolist():
            starts.append(at)
            cost += self.block_grows[at][code]
            at = self.block_after[at][code]
        if whole < len(symbols):
            starts.append(at)
            for sym in symbols[whole:]:
                cost += self.grows[at][sym]
                at = self.after[at][sym]
        return starts, at, cost

    def _with_inserts(self, vector: tuple[int, ...], marked: int) -> int:
        """Marked states, and those from which inserts lead to one at no loss."""
        for _ in range(3):
            for q in range(4):
                if marked >> THEN[q] & 1 and vector[q] + INSERT == vector[THEN[q]]:
                    marked |= 1 << q
        return marked

    def marks_end(self, last: int) -> tuple[int, int]:
        """States on cheapest paths after the last message, and their cost at the end."""
        vector = self.vectors[last]
        best = min(vector[q] for q in ENDS)
        return self._with_inserts(vector, sum(1 << q for q in ENDS if vector[q] == best)), best

    def marks_before(self, number: int, sym: int, marked: int) -> int:
        """Marked states before a message, from those after it."""
        known = self._before.get((number, sym, marked))
        if known is not None:
            return known
        vector, new, grows = self.vectors[number], self.vectors[self.after[number][sym]], self.grows[number][sym]
        out = 0
        for q, x in enumerate(vector):
            if x < NEVER and any(marked >> to & 1 and x + cost == grows + new[to] for _, cost, to in edges(q, sym)):
                out |= 1 << q
        out = self._before[number, sym, marked] = self._with_inserts(vector, out)
        return out

    def read(self, number: int, sym: int, marked: int, state: int) -> tuple[str, int]:
        """Least initials up to and with a message's edit, and the state after it; ``marked``: the states after it."""
        known = self._read.get((number, sym, marked, state))
        if known is not None:
            return known
        vector, new, grows = self.vectors[number], self.vectors[self.after[number][sym]], self.grows[number][sym]
        here, at, out, name = self.marks_before(number, sym, marked), state, "", "I"
        while name == "I":
            ways = [(name, to) for name, cost, to in edges(at, sym)
                    if marked >> to & 1 and vector[at] + cost == grows + new[to]]
            if here >> THEN[at] & 1 and vector[at] + INSERT == vector[THEN[at]]:
                ways.append(("I", THEN[at]))
            name, at = min(ways)
            out += name
        self._read[number, sym, marked, state] = out, at
        return out, at

    def cheapest_edits(self, symbols: bytes) -> tuple[int, str]:
        """The least cost, and of the cheapest edits' initials the ASCII-least."""
        starts, last, cost = self.walk(symbols)
        n = len(symbols)
        marks = bytearray(n + 1)
        marks[n], rest = self.marks_end(last)
        for k in range(len(starts) - 1, -1, -1):  # blocks, expanded backward
            lo = k * self.block
            own = symbols[lo:lo + self.block]
            inner = [starts[k]]
            for sym in own[:-1]:
                inner.append(self.after[inner[-1]][sym])
            for i in range(len(own) - 1, -1, -1):
                marks[lo + i] = self.marks_before(inner[i], own[i], marks[lo + i + 1])
        out, at, state = [], 0, NOTHING
        for i, sym in enumerate(symbols):
            piece, state = self.read(at, sym, marks[i + 1], state)
            out.append(piece)
            at = self.after[at][sym]
        while state not in ENDS or self.vectors[last][state] != rest:  # inserts at the end
            out.append("I")
            state = THEN[state]
        return cost + rest, "".join(out)
