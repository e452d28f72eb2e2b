"""Compare a query with its SQL on the same Parquet tables; also a command line tool: oracle.py [--sf DIR] [KEY...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(arrow, names):
    return sorted(zip(*[arrow.column(n).to_pylist() for n in names]), key=lambda r: [(v is None, str(type(v)), v) for v in r])


def _kind(t) -> str:
    return {"large_string": "string", "string_view": "string"}.get(str(t), str(t))


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when both sides have the same columns, types and rows."""
    mine, theirs = df.toArrow(), con.execute(sql).to_arrow_table()
    a, b = sorted(mine.column_names), sorted(theirs.column_names)
    if a != b:
        return [f"columns only in the query {sorted(set(a) - set(b))}, only in the SQL {sorted(set(b) - set(a))}"]
    out = []
    for n in a:
        x, y = _kind(mine.schema.field(n).type), _kind(theirs.schema.field(n).type)
        if x != y:
            out.append(f"type of {n}: {x} vs {y}")
    if mine.num_rows != theirs.num_rows:
        return out + [f"rows {mine.num_rows} vs {theirs.num_rows}"]
    if mine.num_rows == 0:
        out.append("both sides are empty")
    left, right = _rows(mine, a), _rows(theirs, a)
    bad = [(l, r) for l, r in zip(left, right) if l != r and not all(
        u == v or (isinstance(u, float) and isinstance(v, float) and math.isnan(u) and math.isnan(v)) for u, v in zip(l, r))]
    if bad:
        out.append(f"{len(bad)} of {len(left)} rows differ, first: "
                   + str({n: (u, v) for n, u, v in zip(a, *bad[0]) if u != v or len(a) < 8}))
    return out


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wrong = 0
    for name in argv or list(queries):
        for k in [q for q in queries if q == name or (name.endswith("*") and q.startswith(name[:-1]))] or [name]:
            start = time.time()
            try:
                df = queries[k](spark, sf_dir)
                if k in oracle:
                    found = compare(df, con, oracle[k])
                else:
                    found = [] if (n := df.count()) else ["no rows"]
                    k = f"{k} (rows only: {n})"
            except Exception as e:  # noqa: BLE001
                found = [f"{type(e).__name__}: {str(e)[:1500]}"]
            wrong += bool(found)
            print(f"{'FAIL' if found else 'ok  '} {time.time() - start:6.2f}s {k} {'; '.join(found)}", flush=True)
    print("wrong:", wrong)
    return wrong


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    sys.exit(bool(main(sys.argv[1:])))
