"""Rows of Spark and of DuckDB in one comparable form."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
