import decimal


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(spark_df, duck, sql):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert as_rows(spark_df.columns, spark_df.collect()) == as_rows(names, cur.fetchall())
