"""Texts of records and reports, and sinks that replace or append."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import escape_html, text


def to_lino(data: Column) -> Column:
    """A record in links notation, keys in order; keys that start with an underscore and nulls are left out, booleans and numbers bare."""
    entries = F.array_sort(F.filter(F.map_entries(data), lambda e: ~e["key"].startswith("_") & e["value"].isNotNull()))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))
    shown = lambda v: F.when(v.rlike(r"^(true|false|-?[0-9]+(\.[0-9]+)?)$"), v).otherwise(quoted(v))
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), e["key"], F.lit(" "), shown(e["value"])))
    return F.concat_ws("\n", F.lit("("), F.array_join(lines, "\n"), F.lit(")"))


def field_table(data: Column, hidden: list[str] = ()) -> Column:
    """A Markdown table of a record's fields in order, without hidden ones; pipes are escaped."""
    skip = F.array(*[F.lit(h) for h in hidden]).cast("array<string>")
    entries = F.array_sort(F.filter(F.map_entries(data), lambda e: ~F.array_contains(skip, e["key"])))
    cell = lambda v: F.replace(text(v), F.lit("|"), F.lit("\\|"))
    rows = F.transform(entries, lambda e: F.concat(F.lit("| "), cell(e["key"]), F.lit(" | "), cell(e["value"]), F.lit(" |")))
    return F.concat_ws("\n", F.lit("| Field | Value |"), F.lit("| --- | --- |"), F.array_join(rows, "\n"))


ICONS = {"MATCH": "✅", "MISMATCH": "❌", "INFO": "ℹ️"}


def check_report(checks: DataFrame) -> DataFrame:
    """(entity, markdown): a line per check of an entity in order of its field, and the number of mismatches."""
    icon = F.element_at(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv]), F.col("status"))
    line = F.concat(F.lit("- "), icon, F.lit(" "), F.col("field"), F.lit(": "), F.col("status"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda s: s["line"]), "\n")
    head = F.concat(F.lit("# "), F.col("entity").cast("string"), F.lit("\n\n"))
    grouped = checks.groupBy("entity").agg(body.alias("body"), F.count_if(F.col("status") == "MISMATCH").alias("n"))
    return grouped.select("entity", F.concat(head, "body", F.lit("\n\nMismatches: "), F.col("n").cast("string"), F.lit("\n")).alias("markdown"))


def fixed_width(df: DataFrame) -> DataFrame:
    """(line): a small report's rows as text, each column padded to its longest value; the header comes first."""
    cells = df.select(*[text(F.col(c)).alias(c) for c in df.columns])
    width = cells.agg(*[F.max(F.length(c)).alias(c) for c in cells.columns]).first()
    pad = {c: max(len(c), width[c] or 0) for c in cells.columns}
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(c, pad[c], " ") for c in cells.columns]))
    head = "  ".join(c.ljust(pad[c]) for c in cells.columns).rstrip()
    return df.sparkSession.createDataFrame([(0, head)], "n int, line string").unionByName(cells.select(F.lit(1).alias("n"), line.alias("line"))).orderBy("n", "line").select("line")


def mail(sender: Column, subject: Column, date: Column, html: Column) -> Column:
    """A mail with the headers that aren't null and an HTML body."""
    header = lambda n, c: F.concat(F.lit(f"{n}: "), c)
    head = F.concat_ws("\r\n", header("From", sender), header("Subject", subject), header("Date", date), F.lit("MIME-Version: 1.0"), F.lit("Content-Type: text/html; charset=utf-8"))
    return F.concat(head, F.lit("\r\n\r\n"), text(html))


def mail_page(headers: Column, html: Column, plain: Column) -> Column:
    """A page of a mail: its headers as a table, and its HTML, or its text in ``pre``."""
    rows = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit("<tr><th>"), escape_html(e["key"]), F.lit("</th><td>"), escape_html(e["value"]), F.lit("</td></tr>")))
    body = F.coalesce(html, F.concat(F.lit("<pre>"), escape_html(plain), F.lit("</pre>")))
    return F.concat(F.lit("<!doctype html><meta charset=utf-8><table>"), F.array_join(rows, ""), F.lit("</table>"), body)


def message_file(date: Column, subject: Column, content: Column) -> Column:
    """``yyyy-MM-dd-subject-hash``: the same for the same message."""
    from docweave.functions.text import slug

    return F.concat_ws("-", F.date_format(date, "yyyy-MM-dd"), slug(subject, 40), F.substring(F.sha1(content), 1, 8))


def facts(rows: DataFrame) -> DataFrame:
    """(chat, links): a chat's facts (chat, property, value) in order of property, nulls left out."""
    pair = F.struct("property", "value")
    return rows.where("value IS NOT NULL").groupBy("chat").agg(F.array_sort(F.collect_list(pair)).alias("links"))


def replace_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: the new one is written beside it, and takes its place only once it is whole.

    A job that fails leaves the old table as it was. Between the two renames,
    a moment each on a file system, there is no table at ``path``; a reader that
    has listed the old files finds them gone after it. Where tables are replaced
    while they are read, use ``versions.publish``.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    tag = uuid.uuid4().hex
    df.write.parquet(f"{path}-new-{tag}")
    jvm = spark._jvm
    here, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-new-{tag}", f"{path}-old-{tag}"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(here)
    if had and not fs.rename(here, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(fresh, here):
        if had:
            fs.rename(old, here)
        raise OSError(f"can't publish {path}")
    if had:
        fs.delete(old, True)


def append_json(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to the JSON lines at ``path``; null fields are left out, and an empty frame adds none."""
    df.write.mode("append").json(path)


def split_visual(people: DataFrame) -> DataFrame:
    """(entity, doc_type, field, value) of ``people`` (entity, documents: map of type to map of fields); empty documents give none."""
    documents = people.select("entity", F.explode("documents").alias("doc_type", "data")).where("data IS NOT NULL")
    return documents.select("entity", "doc_type", F.explode("data").alias("field", "value"))
