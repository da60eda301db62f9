"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WS = re.compile("[ \x09-\x0d]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


# -- personal data and secrets ----------------------------------------------------

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SECRETS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_passes(kind, m):
    digits = "".join(c for c in m[0] if c.isdigit())
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def secret_passes(kind, m):
    return len(m[1]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]


def spans(text, patterns, passes):
    """Counts by kind and the joined spans."""
    names = list(patterns)
    found = sorted((m.start(), i, m.end()) for i, k in enumerate(names)
                   for m in patterns[k].finditer(text or "") if passes(k, m))
    joined = ",".join(f"{names[i]}:{s}:{e}" for s, i, e in found)
    return [sum(f[1] == i for f in found) for i in range(len(names))], joined


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- quality ----------------------------------------------------------------------

def quality(text):
    w = words(text)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k:k + 8])].append(k)
    covered = set()
    for places in at.values():
        if len(places) > 1:
            for k in places:
                covered.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed)


# -- lines ------------------------------------------------------------------------

def one_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = 0
    while front < short and a[front] == b[front]:
        front += 1
    back = 0
    while back < short and a[-1 - back] == b[-1 - back]:
        back += 1
    return max(len(a), len(b)) - min(front + back, short) <= 1


def dropped_lines(rows, least=6):
    """rows in order: (key, text) -> {key: (repeated, near)} line numbers."""
    first, out, order = {}, collections.defaultdict(lambda: (set(), set())), []
    for key, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            w = tuple(words(line))
            if not w:
                continue
            if w in first:
                out[key][0].add(n)
            else:
                first[w] = (key, n)
                order.append(w)
    long = [w for w in order if len(w) >= least]
    by_size = collections.defaultdict(list)
    for w in long:
        if any(one_apart(w, v) for k in (len(w) - 1, len(w), len(w) + 1) for v in by_size[k]):
            out[first[w][0]][1].add(first[w][1])
        by_size[len(w)].append(w)
    return out


# -- near duplicates ---------------------------------------------------------------

def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(nodes, links):
    low = {n: n for n in nodes}

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# -- repeated bytes -----------------------------------------------------------------

def repeated(texts, length):
    """Removed flags of every text (bytes)."""
    count = collections.Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s:s + length]] > 1:
                flags[s:s + length] = b"\x01" * length
        out.append(flags)
    return out
