"""What several test modules share."""


def rows(df, *order):
    """The rows of a table as tuples, in the order of the given columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
