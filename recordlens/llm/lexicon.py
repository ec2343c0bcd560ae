"""A minimal acyclic transducer over byte strings, as arrays that are memory-mapped and walked in lockstep."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

#: Arrays start at multiples of this many bytes of a file.
_ALIGN = 64


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and finality of the states of the minimal automaton of sorted distinct words; state 0 is the start.

    Words are added in order: what the last word doesn't share with the next one is final, so its
    states are replaced by equal ones that were seen before. States with equal suffixes are one.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    spare: list[int] = []
    path = [0]  # states of the last word
    last = b""

    def settle(depth: int, word: bytes) -> None:
        for at in range(len(word), depth, -1):
            state = path.pop()
            key = (final[state], *arcs[state].items())
            same = known.setdefault(key, state)
            if same != state:
                arcs[path[-1]][word[at - 1]] = same
                arcs[state], final[state] = {}, False
                spare.append(state)

    for word in words:
        if word <= last and last:
            raise ValueError("words must be sorted and distinct")
        shared = 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        settle(shared, last)
        for byte in word[shared:]:
            if spare:
                state = spare.pop()
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0, last)
    return arcs, final


def _below(arcs: list[dict[int, int]], final: list[bool]) -> list[int]:
    """How many words each state's paths spell."""
    found: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        open_ = [t for t in arcs[state].values() if t not in found]
        if open_:
            todo.extend(open_)
            continue
        todo.pop()
        found[state] = final[state] + sum(found[t] for t in arcs[state].values())
    return [found.get(state, 0) for state in range(len(arcs))]


def _placed(arcs: list[dict[int, int]], used: list[int]) -> tuple[list[int], int]:
    """For each state a base: cell ``base + byte`` is free for each of its arcs. States with most arcs choose first."""
    size = 512 + 2 * sum(len(arcs[s]) for s in used)
    taken = bytearray(size)
    base = [0] * len(arcs)
    low, width = 0, 0
    end = 256
    for state in sorted(used, key=lambda s: -len(arcs[s])):
        own = sorted(arcs[state])
        if len(own) != width:
            low, width = 0, len(own)
        at, tries = max(low, own[0]), 0
        while True:
            at = taken.find(0, at)
            if at < 0 or at + 256 >= len(taken):
                taken.extend(bytes(len(taken)))
                at = max(low, own[0])
                continue
            start = at - own[0]
            if all(not taken[start + b] for b in own[1:]):
                break
            at += 1
            tries += 1
            if tries == 64:  # what lies before is too full for so many arcs
                low, tries = at, 0
        base[state] = start
        for b in own:
            taken[start + b] = 1
        end = max(end, start + 257)
    return base, end


class Lexicon:
    """Byte strings with a number each, in sorted order; the numbers of the arcs on a word's path add up to its own.

    ``base``, ``owner``, ``target`` and ``number`` are the transducer: the arc of a state for a byte
    is cell base[state] + byte, if that cell's owner is the state. ``ends`` marks final states.
    Further arrays travel in the same file.
    """

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.base, self.owner, self.target, self.number, self.ends = (arrays[n] for n in ("base", "owner", "target", "number", "ends"))
        self.longest = int(arrays["longest"][0])

    @classmethod
    def compile(cls, words: list[bytes], **more: np.ndarray) -> Lexicon:
        """``words`` are sorted, distinct and not empty."""
        arcs, final = minimal_automaton(words)
        count = _below(arcs, final)
        used = [s for s in range(len(arcs)) if arcs[s]]
        base, cells = _placed(arcs, used)
        dead = len(arcs)  # a state without arcs
        owner, target, number = np.full(cells, -1, np.int32), np.full(cells, dead, np.int32), np.zeros(cells, np.int32)
        for state in used:
            at, before = base[state], int(final[state])
            for byte, to in sorted(arcs[state].items()):
                owner[at + byte], target[at + byte], number[at + byte] = state, to, before
                before += count[to]
        return cls({
            "base": np.array([*base, 0], np.int32), "owner": owner, "target": target, "number": number,
            "ends": np.array([*final, False]), "longest": np.array([max(map(len, words), default=0)]), **more,
        })

    @property
    def states(self) -> int:
        return len(np.unique(self.target)) if len(self.target) else 1

    def to_bytes(self) -> bytes:
        """One file: a line that lists the arrays, then the arrays, aligned."""
        at, listed, parts = 0, [], []
        for name, array in self.arrays.items():
            raw = np.ascontiguousarray(array).tobytes()
            pad = -len(raw) % _ALIGN
            listed.append([name, array.dtype.str, len(array), at])
            parts.append(raw + bytes(pad))
            at += len(raw) + pad
        head = json.dumps(listed).encode() + b"\n"
        head = head[:-1] + b" " * (-len(head) % _ALIGN) + b"\n"
        return head + b"".join(parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The file's arrays without reading them: pages come as they are touched, once a machine."""
        with open(path, "rb") as file:
            head = file.readline()
        whole = np.memmap(path, np.uint8, "r", offset=0)
        arrays = {}
        for name, kind, length, at in json.loads(head):
            start = len(head) + at
            arrays[name] = np.asarray(whole[start : start + length * np.dtype(kind).itemsize]).view(kind)
        return cls(arrays)

    def find(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each stretch of ``raw`` (bytes), or -1 where it is no word. Longer ones are walked first."""
        order = np.argsort(-np.minimum(length, self.longest + 1).astype(np.int16), kind="stable")
        sizes = length[order]
        at = start[order]
        first = int(np.searchsorted(-sizes, -self.longest))  # too long for any word
        at, sizes = at[first:], sizes[first:]
        ends_at = np.searchsorted(-sizes, -np.arange(1, self.longest + 1), side="right")  # how many have so many bytes
        state, number = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for step, live in enumerate(ends_at.tolist()):
            if not live:
                break
            own = state[:live]
            cell = self.base[own] + raw[at[:live] + step]
            good = self.owner[cell] == own
            number[:live] += self.number[cell]
            state[:live] = np.where(good, self.target[cell], len(self.base) - 1)
        out = np.full(len(start), -1, np.int32)
        out[order[first:]] = np.where(self.ends[state], number, -1)
        return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[k], start[k] + 1, ... of all stretches, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)
