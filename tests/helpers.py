"""Helpers of the tests beside this file; `conftest` is no module to import from, since each test folder has its own."""


def rows(df, *columns):
    """Sorted tuples of a frame."""
    cols = columns or df.columns
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(v is None, str(v)) for v in r])
