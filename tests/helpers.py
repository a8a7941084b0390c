"""Shared by all tests."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(a, b):
    """Asserts that two pandas frames hold the same rows, whatever their order."""
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return float(v) + 0.0
        except (TypeError, ValueError):
            return str(v)

    def key(row):
        return [f"{v:.2f}" if isinstance(v, float) else v for v in row]

    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None)), key=key)
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4)
    left, right = rows(a), rows(b)
    wrong = [(x, y) for x, y in zip(left, right, strict=True) if not all(map(near, x, y))]
    assert not wrong, wrong[:3]
