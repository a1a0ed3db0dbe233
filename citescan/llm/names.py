"""Names for columns that an operator adds to rows of unknown columns."""

from pyspark.sql import DataFrame


def free(df: DataFrame, *names: str) -> list[str]:
    """Each of ``names`` with as many underscores before it as it takes to be no column of ``df``, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
