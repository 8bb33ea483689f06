"""Direct readings of the rules, a document at a time, to hold the operators against."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def private(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            plain = re.sub(r"[^0-9]", "", m.group())
            holds = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(plain) <= 19 and luhn(plain),
                "phone": 9 <= len(plain) <= 15,
            }
            if holds[kind]:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def form_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def leaks(text, items, size=10):
    words, hit, names = form_words(text), set(), set()
    for name, item in items:
        own = form_words(item)
        for k in range(max(1, len(own) - size + 1) if own else 0):
            window = own[k : k + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


def shingles(text, n=5):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def classes(docs, threshold=0.8):
    """doc_id to the least doc_id of its class, by all pairs."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = dict(docs)
    for a, b in itertools.combinations(sorted(root), 2):
        one, two = sets[a], sets[b]
        same = (texts[a] or "") == (texts[b] or "")
        if same or (one and two and len(one & two) / len(one | two) >= threshold):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, doubled = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {
        at for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for at in range(k, k + 8)
    }
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def repeats(docs, min_words=6):
    """(doc_id, start, end, first_id) of the sentences that go. `docs` have different ids, no nulls."""
    first, gone = {}, []
    for i, text in sorted(docs):
        key, at = None, 0
        for part in re.findall(r"[^\n]*?(?<=[.!?])[^\S\n]+|[^\n]*\n|[^\n]+$", text):
            words = tuple(part.lower().split())
            if words and (len(words) >= min_words or key):
                key = words if len(words) >= min_words else (key, words)
                if key in first:
                    gone.append((i, at, at + len(part), first[key]))
                else:
                    first[key] = i
            at += len(part)
        assert at == len(text)
    return sorted(gone)
