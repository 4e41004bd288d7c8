"""Rows of a small result in an order of their own."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
