"""Comparison helpers shared by the tests."""

import datetime as dt
import decimal
import json
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (bool, int)):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return json.dumps([norm(x) for x in v])
    if isinstance(v, dict):
        return json.dumps({k: norm(x) for k, x in sorted(v.items())})
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([norm(r[i]) for i in order]) for r in rows)


def rows_of(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])
