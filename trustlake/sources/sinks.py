"""Writers, upserts and small formatted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a fixed column order, all values quoted, nested ones as JSON."""
    df = df.select(*(columns or df.columns))
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    df.withColumns(nested).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def map_document(df: DataFrame, key: str) -> DataFrame:
    """A small table as one JSON map from ``key`` to the other columns."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), rest))))).alias("value"))


def write_map_json(df: DataFrame, path: str, key: str) -> None:
    map_document(df, key).write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose keys aren't among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def append_capped(old: DataFrame, new: DataFrame, n: int = 500, ts: str = "ts") -> DataFrame:
    """Both, newest first, at most n."""
    return new.unionByName(old, allowMissingColumns=True).orderBy(F.desc(ts)).limit(n)


def _cell(x: object) -> str:
    return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def to_markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read; aggregate first")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(x) for x in r) + " |" for r in rows])


def to_latex(df: DataFrame, most: int = 200) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read; aggregate first")
    safe = lambda s: s.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(safe(x) for x in df.columns) + r" \\ \hline"] + [" & ".join(safe(_cell(x)) for x in r) + r" \\" for r in rows]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + "\n".join(body) + "\n\\end{tabular}"
