"""Rows of two engines, made comparable."""

import decimal


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    right = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert left == right
    return len(left)
