"""Probabilistic automata by state merging (on the driver, over a bounded sample).

A state of the prefix tree stands for the strings that share a prefix; what it
knows is their rests.  From the root down, a state is merged

* with a state of the same depth whose rests are alike: at every distance
  ahead, the shares of character classes and of ends differ by no more than
  the Hoeffding bound.  Where counts are too few to tell, the evidence of its
  siblings stands for its own: the state joins one of its depth with a rest as
  long as one of its own, unless most characters ahead are of another kind;
* with a state one level up, which makes a loop, only on evidence: both have
  ``ENOUGH`` rests, all shares are alike, and ends among them.

So fixed formats become chains that keep literal prefixes and lengths, and only
runs that may end anywhere become loops.  A step costs the character's share
among the state's characters, mixed with its class's share spread evenly over
the class, so that few examples already speak for the class.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

# Character classes; every other character is a class of its own.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: k for k, chars in CLASSES.items() for c in chars}
SIZE = {k: len(chars) for k, chars in CLASSES.items()}
FLOOR = -14.0  # log2 probability of a step that the automaton does not know
ENOUGH = 30  # rests that count as evidence for a loop
AHEAD = 32  # characters ahead that are compared


def class_of(c: str) -> str:
    return CLASS_OF.get(c, c)


def kind_of(k: str) -> str:
    """Letters and digits alike, or the character itself."""
    return "word" if k in CLASSES else k


class State:
    def __init__(self, depth: int):
        self.depth = depth
        self.rests: list[tuple[int, int]] = []  # (string, place in it)
        self.next: dict[str, State] | None = None  # None until its rests are dealt on
        self.chars: Counter = Counter()
        self.ends = 0


class Automaton:
    def __init__(self, strings: list[str], alpha: float = 0.001):
        self.strings = strings
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.root = State(0)
        self.root.rests = [(i, 0) for i in range(len(strings))]
        self.states = [self.root]
        level = [self.root]
        while level:
            level = self._next_level(level)
        for state in self.states:
            for i, at in state.rests:
                if at == len(strings[i]):
                    state.ends += 1
                else:
                    state.chars[strings[i][at]] += 1
            state.classes = Counter()
            for c, n in state.chars.items():
                state.classes[class_of(c)] += n
            del state.rests
            state.cost = {}
        self.loops = any(to.depth <= state.depth for state in self.states for to in state.next.values())
        self.lengths = {len(s) for s in strings}
        del self.strings

    # -- learning ------------------------------------------------------------------

    def _deal(self, state: State, rests: list[tuple[int, int]], fresh: list) -> None:
        """Send rests on from a state; new states go to ``fresh``."""
        waiting = [(state, rests)]
        while waiting:
            state, rests = waiting.pop()
            by_char = defaultdict(list)
            for i, at in rests:
                if at < len(self.strings[i]):
                    by_char[self.strings[i][at]].append((i, at + 1))
            for c, group in sorted(by_char.items()):
                to = state.next.get(c)
                if to is None:
                    to = state.next[c] = State(state.depth + 1)
                    fresh.append((state, c))
                to.rests += group
                if to.next is not None:
                    waiting.append((to, group))

    def _next_level(self, level: list[State]) -> list[State]:
        waiting: list[tuple[State, str]] = []
        for state in level:
            state.next = {}
            self._deal(state, state.rests, waiting)
        kept: list[State] = []
        profiles: dict[int, list] = {}
        done = 0
        while done < len(waiting):
            order = sorted(waiting[done:], key=lambda w: (-len(w[0].next[w[1]].rests), w[1]))
            done = len(waiting)
            for source, c in order:
                state = source.next[c]
                match = self._match(state, kept, source, profiles)
                if match is None:
                    kept.append(state)
                    continue
                source.next[c] = match
                match.rests += state.rests
                profiles.pop(id(match), None)
                if match.next is not None:  # a loop: the rests go on from there
                    self._deal(match, state.rests, waiting)
        self.states += kept
        return kept

    def _profile(self, state: State, profiles: dict) -> list:
        """Per distance ahead: rests alive, ends, and classes."""
        found = profiles.get(id(state))
        if found is None:
            found = [[0, 0, Counter()] for _ in range(AHEAD)]
            for i, at in state.rests:
                s = self.strings[i]
                for k in range(min(AHEAD, len(s) - at + 1)):
                    found[k][0] += 1
                    if at + k == len(s):
                        found[k][1] += 1
                    else:
                        found[k][2][class_of(s[at + k])] += 1
            profiles[id(state)] = found
        return found

    def _compare(self, a: list, b: list) -> tuple[bool, bool]:
        """(alike, foreign: too few to tell, and of other lengths or mostly other kinds)."""
        few = other = same_length = 0
        for (na, ea, ca), (nb, eb, cb) in zip(a, b):
            if not na or not nb:
                break
            limit = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(ea / na - eb / nb) > limit or any(abs(ca[k] / na - cb[k] / nb) > limit for k in ca.keys() | cb.keys()):
                return False, False
            same_length += bool(ea and eb)
            if limit >= 1:
                few += 1
                other += not {kind_of(k) for k in ca} & {kind_of(k) for k in cb} and not (ea and eb)
        else:
            same_length += 1  # longer than what is compared
        return True, bool(few) and (not same_length or other > 0.6 * few)

    def _match(self, state: State, kept: list[State], source: State, profiles: dict) -> State | None:
        mine = self._profile(state, profiles)
        for other in kept:
            alike, foreign = self._compare(mine, self._profile(other, profiles))
            if alike and not foreign:
                return other
        if len(state.rests) >= ENOUGH and len(source.rests) >= ENOUGH:
            theirs = self._profile(source, profiles)
            if any(e for n, e, _ in theirs[:1] + mine[:1]) and self._compare(mine, theirs) == (True, False):
                return source
        return None

    # -- scoring --------------------------------------------------------------------

    def _step(self, state: State, c: str, less: int) -> float:
        """log2 share of ``c`` after ``state``, with ``less`` of its own examples left out."""
        total = state.ends + sum(state.chars.values()) - less
        n, k = state.chars.get(c, 0) - less, class_of(c)
        if total <= 0:
            return FLOOR
        own = n / total
        of_class = (state.classes.get(k, 0) - less + 0.25) / (total + 1.5) / SIZE.get(k, 1)
        trust = total / (total + 4 + 2 * len(state.chars))
        return max(FLOOR, math.log2(max(trust * own + (1 - trust) * of_class, 2.0 ** FLOOR)))

    def score(self, text: str, known: bool = False) -> tuple[float, bool]:
        """(log2 of the probability of ``text``, whether some example ends where
        it does); ``known`` leaves one example of it out.  A character that no example
        has at a place goes on as the most frequent one of its class or kind."""
        if not self.loops and not known and len(text) not in self.lengths:
            return FLOOR * (len(text) + 1), False
        state, bits, less = self.root, 0.0, int(known)
        for c in text:
            cost = None if known else state.cost.get(c)
            if cost is None:
                cost = self._step(state, c, less)
                if not known:
                    state.cost[c] = cost
            bits += cost
            to = state.next.get(c)
            if to is None:
                k = class_of(c)
                like = [o for o in state.next if class_of(o) == k] or [
                    o for o in state.next if kind_of(class_of(o)) == kind_of(k)]
                if not like:
                    return bits + FLOOR, False
                to = state.next[max(like, key=lambda o: (state.chars[o], o))]
            state = to
        total = state.ends + sum(state.chars.values()) - less
        return bits + math.log2((state.ends - less + 0.25) / (max(total, 0) + 0.5)), state.ends > 0

    def log2(self, text: str) -> float:
        return self.score(text)[0]

    def chain(self) -> list[str]:
        """The classes on the most frequent way from the start, for inspection."""
        state, out = self.root, []
        while state.next and sum(state.chars.values()) >= state.ends and len(out) < 4 * AHEAD:
            c = max(state.chars, key=lambda o: (state.chars[o], o))
            share = state.chars[c] / sum(state.chars.values())
            out.append(c if share > 0.9 else "".join(sorted({class_of(o) for o in state.chars})))
            state = state.next[c]
        return out


class Background:
    """Ordinary words: characters after two characters, smoothed."""

    def __init__(self, words: list[str]):
        self.pairs: dict[str, dict[str, int]] = {}
        self.single: dict[str, int] = {}
        for w in words:
            w = f"\x02\x02{w}\x03"
            for i in range(2, len(w)):
                row = self.pairs.setdefault(w[i - 2:i], {})
                row[w[i]] = row.get(w[i], 0) + 1
                self.single[w[i]] = self.single.get(w[i], 0) + 1
        self.sums = {k: sum(v.values()) for k, v in self.pairs.items()}
        self.all = sum(self.single.values())

    def log2(self, text: str) -> float:
        w, bits = f"\x02\x02{text}\x03", 0.0
        for i in range(2, len(w)):
            low = (self.single.get(w[i], 0) + 0.5) / (self.all + 128)
            row = self.pairs.get(w[i - 2:i], {})
            bits += math.log2((row.get(w[i], 0) + 4 * low) / (self.sums.get(w[i - 2:i], 0) + 4))
        return bits
