"""Plain Python versions of the operators' definitions, for small inputs."""

import collections
import hashlib
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def documents(spark, rows, extra=True):
    """A documents table of (doc_id, text) rows; with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, DOCS)
    if not extra:
        return df
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in ("row", "node", "component_id", "kept", "item", "kind", "n_words", "key", "leaking")})


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def quality_counts(text):
    w, t = words(text), text or ""
    windows = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.encode().split(b"\n"):
        if words(line.decode()):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def shingle_sets(rows, size):
    out = collections.defaultdict(set)
    for i, t in rows:
        w = words((t or "").encode().lower().decode())
        if w:
            n = min(size, len(w))
            out[i].add(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)))
    return out


def components(rows, size, percent=80):
    sets = shingle_sets(rows, size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) if i in parent else i for i, _ in rows}


def secret_spans(text):
    t, found = text or "", []
    found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    t, found = text or "", []
    found += [(0, m.start(), m.end(), "email") for m in
              re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
              if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append((2, m.start(), m.end(), "card"))
    found += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
              if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for _, a, b, k in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def repeated_bytes(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            k = b[p:p + 50]
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
