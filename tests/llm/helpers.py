"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

SHORT = "doc_id long, text string"

#: Awkward rows: null and empty texts, white space only, ties, repeated rows, a null id, one long run, and columns with clashing names.
AWKWARD = [
    (1, "The same text, told twice."), (2, "the SAME text, told twice."), (3, "the SAME text, told twice."), (3, "the SAME text, told twice."),
    (4, None), (5, ""), (6, " \n\t "), (None, "nobody's text"), (None, None), (7, "É a 日本 🙂 don't 1234"), (8, "word " * 30_000), (9, "x" * 60_000),
]
AWKWARD_SCHEMA = "doc_id long, text string, row string, score double, plain string, id long, label int, n_chars long, slice int, tag long"


def awkward(spark, rows=None):
    rows = AWKWARD if rows is None else rows
    return spark.createDataFrame([(i, t, None, 0.5, "p", 7, 1, None if t is None else len(t), 3, 1) for i, t in rows], AWKWARD_SCHEMA)


def near_classes(rows, similarity=0.8):
    """{doc_id: (smallest doc_id, size)} by comparing all pairs."""
    bags = {}
    for i, text in rows:
        words = (text or "").lower().split()
        bags[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            both, either = (bags[a] & bags[b]).total(), (bags[a] | bags[b]).total()
            if a < b and either and both / either >= similarity:
                parent[find(b)] = find(a)
    groups = {}
    for i in bags:
        groups.setdefault(find(i), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def repeated_bytes(rows, length=100):
    """{doc_id: [start, end] spans} of the bytes covered by strings seen before; rows in order."""
    seen, out = set(), {}
    for i, text in rows:
        data, spans = (text or "").encode(), []
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window not in seen:
                seen.add(window)
            elif spans and s <= spans[-1][1]:
                spans[-1][1] = s + length
            else:
                spans.append([s, s + length])
        out[i] = spans
    return out


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found))
