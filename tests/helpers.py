"""Rows in a form that both engines agree on."""


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql, columns):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    return sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
