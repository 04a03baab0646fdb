"""Weighted finite-state transducers over word classes, their composition, and the clause grammar of toxicity made of them.

All machines read a class a word and write one; arcs carry weights that multiply. What depends on the words before is one
composition read from left to right, what depends on the words behind another read from right to left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

#: What the lexicon writes: insult, threat verb, target, negation, report of speech, any other word.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
#: What the grammar writes besides: insults and threats by what they are said to.
NEGATED, REPORTED, AIMED, THREATENED = "negated", "reported", "aimed", "threatened"
WORDS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)

#: Words that a negation reaches; words in front of an insult, and behind one, in which a target counts.
NEGATION_REACH, TARGET_BEFORE, TARGET_BEHIND = 3, 4, 3
#: A clause says something if it has so many words besides its insults and threats; else, as in a list, they are only named.
SAYING = 1


@dataclass(frozen=True)
class Machine:
    """Deterministic transducer: arcs (state, class) -> (state, class, weight), and a weight for each state a clause may end in."""

    start: object
    arcs: dict
    final: dict

    def read(self, classes: Iterable[str]) -> tuple[list[str], list[float], float]:
        """The classes written, the weight of each arc, and the weight of the end."""
        state, out, weights = self.start, [], []
        for c in classes:
            state, made, weight = self.arcs[state, c]
            out.append(made)
            weights.append(weight)
        return out, weights, self.final[state]


def machine(start: object, classes: Iterable[str], step: Callable, final: Callable = lambda state: 1.0) -> Machine:
    """The machine whose arcs step(state, class) -> (state, class, weight) gives, from the start as far as they lead."""
    classes, arcs, ends, todo = tuple(classes), {}, {}, [start]
    while todo:
        state = todo.pop()
        if state in ends:
            continue
        ends[state] = final(state)
        for c in classes:
            arcs[state, c] = step(state, c)
            todo.append(arcs[state, c][0])
    return Machine(start, arcs, ends)


def compose(a: Machine, b: Machine, classes: Iterable[str]) -> Machine:
    """The machine that reads what a reads and writes what b makes of what a writes."""

    def step(state, c):
        left, made, w = a.arcs[state[0], c]
        right, out, v = b.arcs[state[1], made]
        return (left, right), out, w * v

    return machine((a.start, b.start), classes, step, lambda state: a.final[state[0]] * b.final[state[1]])


def negation() -> Machine:
    """State: how many words more a negation reaches."""

    def step(reach, c):
        if c == NEGATION:
            return NEGATION_REACH, c, 1.0
        return max(0, reach - 1), NEGATED if c == INSULT and reach else c, 1.0

    return machine(0, WORDS, step)


def reported_speech() -> Machine:
    """State: whether a report came before; what follows it is what somebody else said."""

    def step(told, c):
        return told or c == REPORT, REPORTED if told and c in (INSULT, THREAT) else c, 1.0

    return machine(False, (*WORDS, NEGATED), step)


def target_before() -> Machine:
    """State: how many words more the last target is near."""

    def step(near, c):
        if c == TARGET:
            return TARGET_BEFORE, c, 1.0
        return max(0, near - 1), AIMED if c == INSULT and near else c, 1.0

    return machine(0, (*WORDS, NEGATED, REPORTED), step)


def saying() -> Machine:
    """State: words besides insults and threats, as far as they matter; a clause with too few of them weighs nothing."""
    marked = (INSULT, THREAT, NEGATED, REPORTED, AIMED)

    def step(n, c):
        return n if c in marked else min(SAYING, n + 1), c, 1.0

    return machine(0, (*WORDS, NEGATED, REPORTED, AIMED), step, lambda n: 1.0 if n >= SAYING else 0.0)


def target_behind() -> Machine:
    """Reads from the right; a threat verb counts only with a target behind it."""

    def step(near, c):
        if c == TARGET:
            return TARGET_BEHIND, c, 1.0
        made = AIMED if c == INSULT and near else THREATENED if c == THREAT and near else OTHER if c == THREAT else c
        return max(0, near - 1), made, 1.0

    return machine(0, (*WORDS, NEGATED, REPORTED, AIMED), step)


FORWARD = compose(compose(compose(negation(), reported_speech(), WORDS), target_before(), WORDS), saying(), WORDS)
BACKWARD = target_behind()
#: What may be said in a clause that counts.
CHANNELS = (INSULT, AIMED, NEGATED, REPORTED, THREATENED)


def clause_weights(classes: list[str], weights: list[float]) -> dict[str, float]:
    """The weight that a clause has in each channel, of the classes of its words and their weights in the lexicon."""
    forward, first, end = FORWARD.read(classes)
    out: dict[str, float] = {}
    if end:
        backward, second, _ = BACKWARD.read(reversed(forward))
        for c, w, v, x in zip(reversed(backward), first, reversed(second), weights, strict=True):
            if c in CHANNELS:
                out[c] = out.get(c, 0.0) + w * v * x * end
    return out
