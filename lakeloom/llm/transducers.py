"""Weighted finite-state transducers over the tropical semiring: machines with arcs, lazy composition, shortest paths.

A machine answers ``step(state, label)`` with the arcs that read the label, as (output labels, weight, next state), and ``final(state)`` with the output and the weight of ending there, or
None. So a machine may be a table of arcs (:class:`Machine`) or work arcs out when they are asked for; composition does the latter, as its product is never built whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterable

import numpy as np

Arc = tuple[tuple, float, Hashable]


class Tropical:
    """Weights add along a path, and of several paths the least counts."""

    zero, one = math.inf, 0.0

    @staticmethod
    def plus(a: float, b: float) -> float:
        return a if a <= b else b

    @staticmethod
    def times(a: float, b: float) -> float:
        return a + b


class Machine:
    """Arcs in a table. ``other(state, label)`` gives the arcs of a label without arcs of its own there."""

    start: Hashable = 0

    def __init__(self, other: Callable[[int, Hashable], list[Arc]] | None = None) -> None:
        self.arcs: list[dict[Hashable, list[Arc]]] = [{}]
        self.finals: dict[int, tuple[tuple, float]] = {}
        self.other = other

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def arc(self, a: int, label: Hashable, out: tuple, weight: float, b: int) -> None:
        self.arcs[a].setdefault(label, []).append((out, weight, b))

    def step(self, state: int, label: Hashable) -> list[Arc]:
        found = self.arcs[state].get(label)
        return found if found is not None else self.other(state, label) if self.other else []

    def final(self, state: int) -> tuple[tuple, float] | None:
        return self.finals.get(state)


class Composed:
    """``first``'s output is ``second``'s input. States are pairs; their arcs are worked out when asked for."""

    def __init__(self, first, second) -> None:
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def _through(self, q: Hashable, labels: Iterable, weight: float) -> list[Arc]:
        """``second``'s paths from ``q`` that read all the labels."""
        ways: list[Arc] = [((), weight, q)]
        for x in labels:
            ways = [((*out, *more), Tropical.times(w, v), to) for out, w, at in ways for more, v, to in self.second.step(at, x)]
        return ways

    def step(self, state: tuple, label: Hashable) -> list[Arc]:
        p, q = state
        return [(out, w, (to, end)) for labels, v, to in self.first.step(p, label) for out, w, end in self._through(q, labels, v)]

    def final(self, state: tuple) -> tuple[tuple, float] | None:
        p, q = state
        end = self.first.final(p)
        best = None
        for out, w, at in self._through(q, *end) if end else ():
            last = self.second.final(at)
            if last and (best is None or Tropical.plus(best[1], Tropical.times(w, last[1])) != best[1]):
                best = (*out, *last[0]), Tropical.times(w, last[1])
        return best


def shortest(machine, labels: Iterable) -> tuple[tuple, float] | None:
    """The output and weight of the least path that reads just ``labels``; None if there is none. Of paths of equal weight the one found first is taken."""
    layers: list[dict] = [{machine.start: (Tropical.one, None, ())}]
    for x in labels:
        nxt: dict = {}
        for state, (weight, _, _) in layers[-1].items():
            for out, w, to in machine.step(state, x):
                total, known = Tropical.times(weight, w), nxt.get(to)
                if total < Tropical.zero and (known is None or Tropical.plus(known[0], total) != known[0]):
                    nxt[to] = total, state, out
        layers.append(nxt)
    best = None
    for state, (weight, _, _) in layers[-1].items():
        if end := machine.final(state):
            total = Tropical.times(weight, end[1])
            if best is None or total < best[0]:
                best = total, state, end[0]
    if best is None:
        return None
    total, state, tail = best
    parts = [tail]
    for layer in layers[:0:-1]:
        _, state, out = layer[state]
        parts.append(out)
    return tuple(x for p in reversed(parts) for x in p), total


class Spaces:
    """Sets the mark for spaces and before a text. With ``squeeze``, spaces at both ends go and runs of them are one: then a space is put out when the next character comes."""

    start = "start"

    def __init__(self, mark: str, prefix: bool, squeeze: bool) -> None:
        self.mark, self.prefix, self.squeeze = mark, (mark,) if prefix else (), squeeze

    def step(self, state: str, label: str) -> list[Arc]:
        if self.squeeze and label == " ":
            return [((), Tropical.one, "start" if state == "start" else "gap")]
        before = self.prefix if state == "start" else (self.mark,) if state == "gap" else ()
        return [((*before, self.mark if label == " " else label), Tropical.one, "inside")]

    def final(self, state: str) -> tuple[tuple, float]:
        return (), Tropical.one


class CharacterMap:
    """Replaces, from left to right, the longest key that begins at a place; characters that begin no key stay. A state is what was read and isn't decided yet.

    The keys are a double array of 32-bit units over UTF-8 bytes, as in model files: from a unit, ``offset`` and a byte lead to a unit that must bear that byte as its label; a flag tells
    that the key may end there, and the unit at its offset then holds where in the list of texts the replacement begins.
    """

    start = ""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts = np.frombuffer(blob, np.uint32, size // 4, 4), blob[4 + size :]
        self.known: dict[str, tuple[int, str, bool]] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _walk(self, text: str) -> tuple[int, str, bool]:
        """Characters and replacement of the longest key that ``text`` begins with, and whether longer keys begin with all of ``text``."""
        if (found := self.known.get(text)) is None:
            data, units = text.encode("utf-8", "replace"), self.units
            at, best, value = self._offset(int(units[0])), 0, 0
            for k, byte in enumerate(data):
                at ^= byte
                unit = int(units[at]) if at < len(units) else 0
                if unit & 0x800000FF != byte:
                    break
                at ^= self._offset(unit)
                if unit >> 8 & 1:
                    best, value = k + 1, int(units[at]) & 0x7FFFFFFF
            else:
                next_ = at ^ np.arange(1, 256)
                there = next_ < len(units)
                longer = bool((units[next_[there]] & 0x800000FF == np.arange(1, 256)[there]).any())
                found = len(data[:best].decode()), self.texts[value : self.texts.index(0, value)].decode() if best else "", longer
            if found is None:
                found = len(data[:best].decode()), self.texts[value : self.texts.index(0, value)].decode() if best else "", False
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = found
        return found

    def step(self, state: str, label: str) -> list[Arc]:
        out, state = self._decided(state + label)
        return [(out, Tropical.one, state)]

    def _decided(self, text: str, end: bool = False) -> tuple[tuple, str]:
        out = ""
        while text:
            n, new, longer = self._walk(text)
            if longer and not end:
                break
            out, text = (out + new, text[n:]) if n else (out + text[0], text[1:])
        return tuple(out), text

    def final(self, state: str) -> tuple[tuple, float]:
        return self._decided(state, True)[0], Tropical.one
