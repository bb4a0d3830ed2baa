"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def _key(v):
    return "" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "date") and getattr(v, "hour", 1) == 0 and getattr(v, "minute", 1) == 0:
        v = v.date()
    if type(v).__name__ == "Decimal":
        v = float(v)
    return v if isinstance(v, (int, float)) else str(v).replace("T", " ")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple(_key(v) for v in r))


def assert_same(df, relation):
    ca, a = rows(df.columns, [tuple(r) for r in df.collect()])
    cb, b = rows([d[0] for d in relation.description], relation.fetchall())
    assert ca == cb
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, u, v in zip(ca, x, y):
            if isinstance(u, (int, float)) and isinstance(v, (int, float)):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6), (c, x, y)
            else:
                assert u == v, (c, x, y)
