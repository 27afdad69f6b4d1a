"""Small comparisons shared by the tests."""


def rows(df, *order):
    """Rows as plain tuples, sorted unless an order is given."""
    got = (df.orderBy(*order) if order else df).collect()
    tuples = [tuple(r) for r in got]
    return tuples if order else sorted(tuples, key=repr)


def values(df, column):
    return [r[column] for r in df.collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
