"""Plain forms of the operators, row by row, that the tests hold the Spark ones against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def ngram_groups(docs, n, percent):
    """{row number: (set size, least id of its group)} of (doc_id, text) rows."""
    sets = []
    for _, text in docs:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    parent, find = union_find(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(docs[i][0], len(sets[i]), least.get(find(i)) if sets[i] else docs[i][0]) for i in range(len(docs))]


def repeats_removed(docs, size=50):
    """[(doc_id, words, removed, sha256 of what is kept)]: a null id is larger than all."""
    order = lambda x: (x is None, x)
    first, words = {}, [WORD.findall(t or "") for _, t in docs]
    for (doc_id, _), w in zip(docs, words):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, doc_id), doc_id, key=order)
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if order(first[tuple(w[i : i + size])]) < order(doc_id):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rule_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    """[(start, kind, end)] by start, then kind."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), i, m.end()) for i, (_, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0])]
    return [(s, kinds[i][0], e) for s, i, e in sorted(found)]


def normal_line(line):
    out = "".join(" " if ord(c) < 128 and not c.isalnum() else "0" if c in "123456789" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.sub(" +", " ", out).strip(" ")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
