import pandas as pd


def rows_of(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return "~"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
