"""Cheapest edits of a run of turns: bidirectional Dijkstra over the edit lattice.

A node is (turns passed, state of the role grammar ``(s?(ua)+)?``). Keep, rerole and delete pass a turn, insert
does not. A turn is given by a letter: ``s u a`` for its role's initial, ``o`` for another role, upper case if its text
is truncated, ``x`` if it has to go (blank or duplicate).

Of equally cheap edits the least audit (their initials, in ASCII order) counts. No audit that reaches a node can begin
with another one of the same cost (the rest would be inserts, which cost), so the least audit of a path is made of
the least audits of its parts: labels may be settled per node, runs may be cut, and their tables joined.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial, by state.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
BEFORE = tuple([(r, g) for g in range(4) for r, h in AFTER[g].items() if h == state] for state in range(4))
ENDS = (START, ASSISTANT)
RESTYLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

Label = tuple[int, str]


def _passes(code: str, role: str) -> tuple[int, str] | None:
    """Cost and initial of the edit that lets a turn pass with that role; None if there is none."""
    own, more = code.lower(), TRUNCATED if code.isupper() else 0
    if own == "x":
        return None
    if own == role:
        return more, "K"
    return (more + RESTYLE, "R") if role in "ua" else None


def _forward(codes: str, i: int, g: int):
    for role, h in AFTER[g].items():
        if i < len(codes) and (step := _passes(codes[i], role)):
            yield *step, (i + 1, h)
        if role in "ua":
            yield INSERT, "I", (i, h)
    if i < len(codes):
        yield DELETE, "D", (i + 1, g)


def _backward(codes: str, j: int, h: int):
    for role, g in BEFORE[h]:
        if j and (step := _passes(codes[j - 1], role)):
            yield *step, (j - 1, g)
        if role in "ua":
            yield INSERT, "I", (j, g)
    if j:
        yield DELETE, "D", (j - 1, h)


def cheapest(codes: str, entry: int, exit: int) -> Label | None:
    """(cost, audit) of the cheapest edits that lead from state ``entry`` to state ``exit`` over all turns, or None."""
    n = len(codes)
    done: tuple[dict, dict] = ({}, {})
    # of equal costs, turns nearer to the side's own end come first: keeping is free, so a label is final only then
    heaps: tuple[list, list] = ([(0, 0, "", (0, entry))], [(0, 0, "", (n, exit))])
    best = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        back = int(heaps[1][0][:2] < heaps[0][0][:2])
        cost, _, audit, node = heapq.heappop(heaps[back])
        if node in done[back]:
            continue
        done[back][node] = (cost, audit)
        if node == ((0, entry) if back else (n, exit)):
            best = cost if best is None else min(best, cost)
        for more, letter, at in (_backward if back else _forward)(codes, *node):
            if at in done[1 - back]:
                total = cost + more + done[1 - back][at][0]
                best = total if best is None else min(best, total)
            if at not in done[back]:
                label = letter + audit if back else audit + letter
                heapq.heappush(heaps[back], (cost + more, n - at[0] if back else at[0], label, at))
    if best is None:
        return None
    ends = [done[s][at][1] for s, at in ((0, (n, exit)), (1, (0, entry))) if at in done[s] and done[s][at][0] == best]
    for node, (cost, audit) in done[0].items():
        for more, letter, at in _forward(codes, *node):
            if at in done[1] and cost + more + done[1][at][0] == best:
                ends.append(audit + letter + done[1][at][1])
    return best, min(ends)


def edit_table(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a run: from the start only if it is a conversation's ``first``, to an end of the
    grammar only if it is the ``last``."""
    known = _short if len(codes) <= 16 else _table
    return known(codes, first, last)


def _table(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    entries, exits = (START,) if first else range(4), ENDS if last else range(4)
    return [(g, h, *label) for g in entries for h in exits if (label := cheapest(codes, g, h))]


_short = lru_cache(maxsize=50_000)(_table)


def joined(labels: dict[int, Label], table: list[tuple[int, int, int, str]]) -> dict[int, Label]:
    """Labels by state after one more run."""
    out: dict[int, Label] = {}
    for entry, exit, cost, audit in table:
        if entry in labels:
            at = (labels[entry][0] + cost, labels[entry][1] + audit)
            if exit not in out or at < out[exit]:
                out[exit] = at
    return out
