"""Plain restatements of what the operators return, one document or pair at a time."""

import collections
import hashlib
import re


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """(start, kind order, kind, end) of the base spans."""
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            hit, digits = m.group(0), re.sub("[^0-9]", "", m.group(0))
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),  # noqa: B023
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licence(text):
    """(words, places, first, last, labels) of the phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def grams(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def linked(texts, words=3, percent=90):
    """Set size and smallest linked place for each text."""
    sets = [grams(t, words) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]
