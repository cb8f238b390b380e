"""Reports and playlist files."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def m3u(items: DataFrame) -> DataFrame:
    """SNK16: lines of an extended playlist from (position, seconds, artist, title, path); the first line is the mark."""
    info = F.format_string("#EXTINF:%d,%s - %s", F.col("seconds").cast("int"), "artist", "title")
    rows = items.select("position", F.explode(F.array(F.struct(F.lit(0).alias("i"), info.alias("value")), F.struct(F.lit(1).alias("i"), F.col("path").alias("value")))).alias("x"))
    head = items.sparkSession.createDataFrame([(0, 0, "#EXTM3U")], "position int, i int, value string")
    return head.unionByName(rows.select(F.col("position").cast("int").alias("position"), "x.i", "x.value")).orderBy("position", "i")


def write_m3u(items: DataFrame, path: str) -> None:
    m3u(items).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK17."""
    rows.write.mode("overwrite").csv(path, header=True)


def report(track: dict, features: dict[str, float]) -> str:
    """SNK18: one track's page, from one collected row."""
    cells = "".join(f"<tr><th>{html.escape(k)}</th><td>{v:.2f}</td><td><meter value='{v:.3f}'></meter></td></tr>" for k, v in features.items() if v is not None)
    return f"<!DOCTYPE html><title>{html.escape(str(track['title']))}</title><h1>{html.escape(str(track['title']))}</h1><p>{html.escape(str(track['artist']))}</p><table>{cells}</table>"


def save_arrays(df: DataFrame, path: str) -> None:
    """SNK21: model state as one row of arrays."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict:
    """SNK21: the one row of a saved model's arrays."""
    return spark.read.parquet(path).first().asDict()


def escaped(text: Column) -> Column:
    """SF15: a text for HTML."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def report_column(title: Column, artist: Column, values: Column) -> Column:
    """SNK18, AX18: a track's page with a cell and a bar for each value of a map, as an expression."""
    t, cut = escaped(F.coalesce(title, F.lit(""))), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    cell = lambda e: F.concat(F.lit("<tr><th>"), escaped(e["key"]), F.lit("</th><td>"), F.format_number(e["value"], 2), F.lit("</td><td><div style='width:"), F.round(100 * cut(e["value"])).cast("int"), F.lit("%'></div></td></tr>"))
    cells = F.array_join(F.transform(F.filter(F.map_entries(values), lambda e: e["value"].isNotNull()), cell), "")
    return F.concat(F.lit("<!DOCTYPE html><title>"), t, F.lit("</title><h1>"), t, F.lit("</h1><p>"), escaped(F.coalesce(artist, F.lit(""))), F.lit("</p><table>"), cells, F.lit("</table>"))
