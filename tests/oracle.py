"""A query's rows held against its SQL's, as sorted text."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, **others):
    c = duckdb.connect()
    for t in TABLES:
        if t in others:
            c.register(t, others[t])
        else:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    return "~" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


def same(df, sql, sf_dir, **others):
    """others: Arrow tables that stand for tables of the folder."""
    found = connect(sf_dir, **others).execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    ours = df.collect()
    assert sorted(df.columns) == sorted(names)
    order = [(df.columns.index(n), names.index(n)) for n in sorted(names)]
    a = sorted(tuple(shown(r[i]) for i, _ in order) for r in ours)
    b = sorted(tuple(shown(r[j]) for _, j in order) for r in theirs)
    assert a == b
    return len(a)
