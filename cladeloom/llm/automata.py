"""Minimal acyclic automata over words with counts as weights.

A state has a weight, the occurrences of the phrase that leads to it, and arcs
under words in ascending order. States with the same weight and arcs are one
state. States are listed bottom up, the root last, so every arc leads back in
the list.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np

State = tuple[int, tuple[bytes, ...], tuple[int, ...]]
_HEAD = struct.Struct("<II")


class Automaton:
    """Weighted states, bottom up."""

    __slots__ = ("states", "_arcs")

    def __init__(self, states: list[State]):
        self.states = states
        self._arcs: dict[int, dict[bytes, int]] = {}

    @property
    def root(self) -> int:
        return len(self.states) - 1

    def arcs(self, state: int) -> dict[bytes, int]:
        found = self._arcs.get(state)
        if found is None:
            found = self._arcs[state] = dict(zip(*self.states[state][1:]))
        return found

    def phrases(self, state: int | None = None, before: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """Every phrase with the weight of its state, ascending; the empty phrase leads to the root."""
        state = self.root if state is None else state
        weight, labels, targets = self.states[state]
        yield before, weight
        for label, target in zip(labels, targets):
            yield from self.phrases(target, (*before, label))

    def below(self, state: int) -> Automaton:
        """What follows the phrase of ``state``, as an automaton of its own."""
        wanted, queue = {state}, [state]
        while queue:
            fresh = set(self.states[queue.pop()][2]) - wanted
            wanted |= fresh
            queue.extend(fresh)
        place = {old: new for new, old in enumerate(sorted(wanted))}
        return Automaton([(w, labels, tuple(place[t] for t in targets))
                          for w, labels, targets in (self.states[s] for s in place)])

    def pack(self) -> bytes:
        """Words cannot hold line ends, which separate them here."""
        weights = np.array([s[0] for s in self.states], "<i8")
        sizes = np.array([len(s[1]) for s in self.states], "<u4")
        targets = np.array([t for s in self.states for t in s[2]], "<u4")
        labels = b"\n".join([w for s in self.states for w in s[1]])
        return b"".join([_HEAD.pack(len(weights), len(targets)), weights.tobytes(), sizes.tobytes(), targets.tobytes(), labels])

    @staticmethod
    def unpack(data: bytes) -> Automaton:
        states, arcs = _HEAD.unpack_from(data)
        at = _HEAD.size
        weights = np.frombuffer(data, "<i8", states, at).tolist()
        sizes = np.frombuffer(data, "<u4", states, at + 8 * states).tolist()
        targets = np.frombuffer(data, "<u4", arcs, at + 12 * states).tolist()
        labels = data[at + 12 * states + 4 * arcs:].split(b"\n")
        out, k = [], 0
        for weight, size in zip(weights, sizes):
            out.append((weight, tuple(labels[k:k + size]), tuple(targets[k:k + size])))
            k += size
        return Automaton(out)


class _Register:
    """States made so far, each kind once."""

    def __init__(self):
        self.states: list[State] = []
        self._known: dict[State, int] = {}

    def state(self, weight: int, labels: Sequence[bytes], targets: Sequence[int]) -> int:
        key = (weight, tuple(labels), tuple(targets))
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.states)
            self.states.append(key)
        return found

    def automaton(self, weight: int, labels: Sequence[bytes], targets: Sequence[int]) -> Automaton:
        """The root is a state of its own, so that it is the last."""
        self.states.append((weight, tuple(labels), tuple(targets)))
        return Automaton(self.states)


class Builder:
    """An automaton from phrases in ascending order; only the last path is open to change."""

    def __init__(self):
        self._register = _Register()
        self._open: list[list] = [[0, [], []]]
        self._last: tuple[bytes, ...] = ()

    def add(self, phrase: tuple[bytes, ...], weight: int, first: int | None = None) -> None:
        """Add ``weight`` to the prefixes of ``phrase`` of ``first`` words or more, by default to itself alone."""
        last, k = self._last, 0
        least = min(len(last), len(phrase))
        while k < least and last[k] == phrase[k]:
            k += 1
        self._close(k)
        opened = self._open
        for word in phrase[k:]:
            opened[-1][1].append(word)
            opened.append([0, [], []])
        self._last = phrase
        for state in opened[len(phrase) if first is None else first:]:
            state[0] += weight

    def _close(self, depth: int) -> None:
        opened = self._open
        while len(opened) > depth + 1:
            target = self._register.state(*opened.pop())
            opened[-1][2].append(target)

    def finish(self) -> Automaton:
        self._close(0)
        return self._register.automaton(*self._open[0])


def union(parts: list[Automaton]) -> Automaton:
    """All phrases of the parts, each with the sum of its weights."""
    if len(parts) == 1:
        return parts[0]
    register, known = _Register(), {}

    def arcs(nodes: list[tuple[list[State], State]]) -> tuple[list[bytes], list[int]]:
        met: dict[bytes, list] = {}
        for states, (_, labels, targets) in nodes:
            for label, target in zip(labels, targets):
                below = states[target]
                entry = met.get(label)
                if entry is None:
                    met[label] = [below[0], [(states, below)] if below[1] else []]
                else:
                    entry[0] += below[0]
                    if below[1]:
                        entry[1].append((states, below))
        labels = sorted(met)
        return labels, [merged(*met[label]) for label in labels]

    def merged(weight: int, nodes: list) -> int:
        if not nodes:
            return register.state(weight, (), ())
        key = (weight, *[id(state) for _, state in nodes])
        found = known.get(key)
        if found is None:
            found = known[key] = register.state(weight, *arcs(nodes))
        return found

    roots = [(p.states, p.states[-1]) for p in parts]
    return register.automaton(sum(r[0] for _, r in roots), *arcs(roots))


def pruned(automaton: Automaton, least: int) -> Automaton:
    """Without the states of less than ``least`` that lead to none of ``least`` or more."""
    register, moved = _Register(), []
    for weight, labels, targets in automaton.states:
        kept = [(label, moved[t]) for label, t in zip(labels, targets) if moved[t] is not None]
        if len(moved) == automaton.root:
            return register.automaton(weight, [k[0] for k in kept], [k[1] for k in kept])
        small = weight < least
        moved.append(None if small and not kept else
                     register.state(0 if small else weight, [k[0] for k in kept], [k[1] for k in kept]))
    raise ValueError("an automaton has a root")


def composed(query: Automaton, counts: Automaton) -> tuple[Automaton, list[tuple[bytes, ...]]]:
    """The phrases of ``query`` with the weights of ``counts``, and those weighted alike in both."""
    register, alike, known = _Register(), [], {}

    def walk(q: int, c: int, before: tuple[bytes, ...]) -> tuple[int, list[bytes], list[int]]:
        wanted, labels, targets = query.states[q]
        weight = counts.states[c][0]
        if wanted and wanted == weight:
            alike.append(before)
        arcs = counts.arcs(c)
        kept = [(label, t) for label, t in zip(labels, targets) if label in arcs]
        below = [register.state(*walk(t, arcs[label], (*before, label))) for label, t in kept]
        return weight, [label for label, _ in kept], below

    return register.automaton(*walk(query.root, counts.root, ())), alike
