"""Hand-over documents as ordered lines, and their Markdown and HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def section(df: DataFrame, keys: list[str], number: int, order: list[Column], text: Column) -> DataFrame:
    """Rows of ``df`` as lines of one section; ``order`` decides their place among each other."""
    return df.select(*keys, F.lit(number).alias("section"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]).cast("string").alias("place"), text.alias("line"))


def titled(sections: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """All lines with a heading for each section that has any."""
    out = None
    for title, lines in sections:
        heads = lines.select(*keys, "section").distinct().select(*keys, "section", F.lit("").alias("place"), F.concat(F.lit("## "), F.col("section").cast("string"), F.lit(f". {title}")).alias("line"))
        part = heads.unionByName(lines)
        out = part if out is None else out.unionByName(part)
    return out


def markdown(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One document for each key, its lines in order."""
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("l"))
    return held.select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def _inline(text: str) -> str:
    text = html.escape(text, quote=True)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    return re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)


def html_of(text: str, title: str) -> str:
    """Headings, lists, fences, quotes and paragraphs of a Markdown text as HTML."""
    out, kind, fence = [], "", False

    def close() -> None:
        nonlocal kind
        if kind:
            out.append(f"</{kind}>")
            kind = ""

    for line in text.split("\n"):
        if line.startswith("```"):
            close()
            out.append("</code></pre>" if fence else "<pre><code>")
            fence = not fence
        elif fence:
            out.append(html.escape(line))
        elif found := re.match(r"(#{1,4}) (.*)", line):
            close()
            out.append(f"<h{len(found[1])}>{_inline(found[2])}</h{len(found[1])}>")
        elif found := re.match(r"(?:([-*])|\d+\.) (.*)", line):
            wanted = "ul" if found[1] else "ol"
            if kind != wanted:
                close()
                out.append(f"<{wanted}>")
                kind = wanted
            out.append(f"<li>{_inline(found[2])}</li>")
        elif line.startswith("> "):
            close()
            out.append(f"<blockquote>{_inline(line[2:])}</blockquote>")
        elif line.strip():
            close()
            out.append(f"<p>{_inline(line.strip())}</p>")
        else:
            close()
    close()
    if fence:
        out.append("</code></pre>")
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body>\n" + "\n".join(out) + "\n</body></html>"


def as_html(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with their HTML; each is rendered by itself, in Arrow batches."""
    @pandas_udf("string")
    def render(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([html_of(a, b) for a, b in zip(texts, titles)])

    return documents.select(*keys, render("markdown", F.concat_ws(" ", *keys)).alias("html"))


def document_name(project: Column, ending: str) -> Column:
    return F.concat(F.lit("handover_"), F.regexp_replace(project, r'[\\/:*?"<>|\s]+', "_"), F.lit(ending))


def written(documents: DataFrame, keys: list[str], folder: str, ending: str = ".md") -> None:
    """Writes documents to ``folder``: ``.html`` gives pages, ``.pdf`` is refused, every other ending Markdown. One row of the text output is one document."""
    if ending == ".pdf":
        raise ValueError("PDF is not written; use .html")
    pages = as_html(documents, keys).withColumnRenamed("html", "value") if ending == ".html" else documents.withColumnRenamed("markdown", "value")
    pages.withColumn("name", document_name(F.concat_ws("_", *keys), ending)).select("name", "value").write.mode("overwrite").parquet(folder)
