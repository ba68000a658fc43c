"""Comparisons that several tests share."""

import pandas as pd


def same_rows(a, b) -> None:
    """Equal frames but for the order of rows and columns."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    shown = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda f: sorted((tuple(shown(v) for v in r) for r in f[columns].astype(object).itertuples(index=False)), key=str)
    assert rows(a) == rows(b)
