"""Plain helpers of the tests; a module of its own, as each folder of tests has a conftest."""


def values(df, column):
    return [row[column] for row in df.collect()]
