"""Order-insensitive comparison of a Spark result with DuckDB rows."""

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    found = con.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    want = sorted(tuple(cell(dict(zip(have, r))[n]) for n in names) for r in found.fetchall())
    assert got == want
