"""Plain Python versions of the contracts, to compare the queries with."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    own = words((text or "").translate(UPPER))
    if len(own) < size:
        return {tuple(own)} if own else set()
    return {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}


def near_duplicates(docs, percent):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in docs}


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def dedup_lines(docs, least=10):
    """{id: (lines, dropped, text)}"""
    holders = collections.defaultdict(set)
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least:
                holders[line_key(line)].add(i)
    out = {}
    for i, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def quality_counts(text):
    text = text or ""
    own = words(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    count = collections.Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 8)}
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed)


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    kinds = ["assign", "access", "hex"]
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out)]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
