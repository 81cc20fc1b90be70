"""Rows of both engines in one spelling."""

import decimal
from collections import Counter


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def same(df, duck, sql):
    cols = sorted(df.columns)
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    theirs = Counter(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in r.fetchall())
    ours = Counter(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
