"""Small tables with every awkward row, and plain-Python versions of the operators' contracts."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(40))
NEAR = BASE.replace("alpha7 ", "gamma7 ")
OTHER = " ".join(f"delta{i}" for i in range(60))
LINE = "This line of boilerplate is surely longer than forty characters."

DOCS = [
    (1, BASE, "en", "a"), (2, NEAR, "en", "a"), (3, BASE, "en", "b"), (4, OTHER, "de", "b"), (5, None, "en", "a"), (6, "", None, None), (7, "   \t\n ", "de", "a"),
    (8, "short text", "fr", "c"), (9, "short text", "fr", "c"), (10, LONG, "en", "a"), (11, LONG + " " + BASE, "en", None), (12, "!!! ??? 123", "en", "a"),
    (None, BASE, "en", "a"), (None, None, None, None), (13, OTHER + "\n" + LINE, "de", "b"), (14, LINE.upper() + "  \nx", "en", "a"), (15, "a\n" + LINE + "\n" + LINE, "en", "a"),
    (16, LINE, "en", "b"), (17, "  " + LINE, "en", "b"), (18, LINE + "\nlast", "en", "b"), (18, LINE + "\nlast", "en", "b"), (-4, "Ünïcode ß 中文 emoji 🙂 tail", "de", "é"), (19, "\x00 nul \x1f byte", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns whose names the operators use inside.
CLASH = ["d", "th", "key", "size", "keep", "n", "label", "row", "span", "start", "family", "fp", "w", "sum", "copy", "rep"]


def docs(spark, rows=DOCS, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASH:
            df = df.selectExpr("*", f"'{c}' AS `{c}`")
    return df


def words(text, lower=True):
    return WORD.findall((text or "").translate(UPPER) if lower else text or "")


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_components(rows, percent=85):
    """doc_id -> (component, set sizes) by all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in up}


def removed_words(rows, window=13):
    """Kept words of each (doc_id, text), in order of the rows."""
    first = {}
    for d, t in rows:
        w = words(t, lower=False)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t, lower=False)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def kept_lines(rows, least=40, docs_=5):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= docs_ and d != max(held[key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out
