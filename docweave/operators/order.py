"""Operators that depend on the order of lines, rows or events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def look_ahead(lines: DataFrame, doc: str, order: str, line: str, following: int = 3) -> DataFrame:
    """Add ``ahead``: the line and the next ``following`` lines of its document, joined by a space."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(0, following)
    return lines.withColumn("ahead", F.array_join(F.collect_list(line).over(w), " "))


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values in order: (key, run, value, first, last, length), ``first`` and ``last`` by the first order column."""
    w = Window.partitionBy(key).orderBy(*order)
    starts = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("_start", starts)
    runs = marked.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def blocks(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Add ``block`` to lines that aren't blank: blank lines part the blocks of a document, which count from 0."""
    w = Window.partitionBy(doc).orderBy(order)
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s", " ")) == ""
    marked = lines.withColumn("_blank", blank).withColumn("_opens", (~F.col("_blank") & F.coalesce(F.lag("_blank").over(w), F.lit(True))).cast("int"))
    return marked.withColumn("block", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("NOT _blank").drop("_blank", "_opens")


def gap_centres(rows: DataFrame, page: str = "page", row: str = "row", blank: str = "blank", least: int = 6) -> DataFrame:
    """(page, centre): the middle, rounded down, of each run of at least ``least`` blank rows."""
    runs = islands(rows, page, [row], blank).where(F.col(blank).cast("boolean") & (F.col("length") >= least))
    return runs.select(page, F.floor((F.col("first") + F.col("last") + 1) / 2).alias("centre"))


def content_box(rows: DataFrame, page: str = "page", row: str = "row", blank: str = "blank") -> DataFrame:
    """(page, first, last) row that isn't blank."""
    return rows.where(~F.col(blank).cast("boolean")).groupBy(page).agg(F.min(row).alias("first"), F.max(row).alias("last"))


def plan_cuts(pages: DataFrame, least: float = 0.45, most: float = 1.6) -> DataFrame:
    """``pages`` (page, height, width, centres) with ``cuts``: from the top, each at the last gap in reach, else at the longest piece.

    A fold over as many steps as the shortest pieces can make.
    """
    longest, shortest = F.round(F.col("width") * most).cast("long"), F.round(F.col("width") * least).cast("long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("height") / F.greatest(shortest, F.lit(1)))))

    def cut(done: Column, _: Column) -> Column:
        top = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long"))
        reach = F.filter("centres", lambda c: (c <= top + longest) & (c >= top + shortest))
        at = F.coalesce(F.array_max(reach), top + longest)
        return F.when(F.col("height") - top > longest, F.concat(done, F.array(at))).otherwise(done)

    return pages.withColumn("cuts", F.aggregate(steps, F.array().cast("array<bigint>"), cut))


def rows_from_words(words: DataFrame, page: str = "page", tolerance: float = 0.6) -> DataFrame:
    """(page, row, text): words (x, y, h, text) in rows; a row starts where y is over ``tolerance`` median heights below the word before."""
    height = words.groupBy(page).agg((F.percentile("h", 0.5) * tolerance).alias("_step"))
    w = Window.partitionBy(page).orderBy("y", "x")
    starts = (F.col("y") - F.lag("y").over(w) > F.col("_step")).cast("int")
    rows = words.join(height, page).withColumn("_starts", F.coalesce(starts, F.lit(0)))
    rows = rows.withColumn("row", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy(page, "row").agg(text.alias("text"))


def sections(pages: DataFrame, doc: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """Add ``section`` to rows from one that starts a section up to the one that ends it, or the next start; other rows go."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("section", F.sum(starts.cast("int")).over(w)).where("section > 0")
    inner = Window.partitionBy(doc, "section").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("_over", F.coalesce(F.max(ends.cast("int")).over(inner), F.lit(0))).where("_over = 0").drop("_over")


def steady(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at): when a key's snapshot first equals the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return snapshots.withColumn("_same", F.lag(value).over(w) == F.col(value)).where("_same").groupBy(key).agg(F.min(order).alias("at"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "20 minutes") -> DataFrame:
    """(key, start, last, n): events of a key that follow each other by less than ``gap``."""
    window = F.session_window(ts, gap)
    return events.groupBy(key, window).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).select(key, "start", "last", "n")


def widest_gap(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, seconds): the longest time between two events of a key."""
    w = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_gap", micros - F.lag(micros).over(w)).groupBy(key).agg((F.max("_gap") / 1_000_000).alias("seconds"))


def stages_reached(events: DataFrame, key: str, kind: str, ts: str, stages: list[str]) -> DataFrame:
    """(key, reached, at_<stage>...): the number of the furthest stage and the first time at each."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(kind))
    return events.groupBy(key).agg(F.max(place).cast("int").alias("reached"), *[F.min(F.when(F.col(kind) == s, F.col(ts))).alias(f"at_{s}") for s in stages])


def last_write(events: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The values of the latest event a key, whatever order events come in."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, *[F.col(f"_v.{v}") for v in values])


def contiguous(arrivals: DataFrame, key: str, seq: str, *order: str) -> DataFrame:
    """Arrivals that can be committed: those up to the first number missing from 1 on.

    Of arrivals of one number the least by the columns ``order`` counts, then
    by the other columns, so chance decides nothing. Null numbers are dropped.
    """
    others = [c for c in arrivals.columns if c not in (key, seq, *order)]
    first = arrivals.where(F.col(seq).isNotNull()).groupBy(key, seq).agg(F.min(F.struct(*order, *others)).alias("_first")) if order or others else arrivals.where(F.col(seq).isNotNull()).select(key, seq).distinct()
    unique = first.select(*(c if c in (key, seq) else F.col(f"_first.{c}").alias(c) for c in arrivals.columns))
    w = Window.partitionBy(key).orderBy(seq)
    return unique.where(F.col(seq) > 0).withColumn("_n", F.row_number().over(w)).where(F.col(seq) == F.col("_n")).drop("_n")


def expired(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows older than ``days`` days at ``as_of``."""
    return rows.where(F.col(ts) < as_of - F.make_dt_interval(F.lit(days)))


def mode_at(events: DataFrame, key: str, order: list[str], mode: str) -> DataFrame:
    """Add ``mode_now``: the last mode a key was given, at each event."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("mode_now", F.last(mode, ignorenulls=True).over(w))


def labelled_values(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """(doc, label, value): ``Label: value`` parts of lines whose columns stand three spaces apart; the first value of a label counts."""
    part = lines.select(doc, order, F.posexplode(F.split(line, r"\s{3,}")).alias("_i", "_part"))
    pattern = r"^\s*([^:]+?)\s*:\s*(.+?)\s*$"
    found = part.where(F.col("_part").rlike(pattern)).select(doc, order, "_i", F.regexp_extract("_part", pattern, 1).alias("label"), F.regexp_extract("_part", pattern, 2).alias("value"))
    return found.groupBy(doc, "label").agg(F.min_by("value", F.struct(order, "_i")).alias("value"))


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line), lines counted from 0."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def split_message(c: Column, limit: int = 4096) -> Column:
    """Blank-line blocks packed in order into messages of at most ``limit`` shown characters; tags don't count, a longer block stands alone."""
    shown = lambda x: F.length(F.regexp_replace(x, "<[^>]*>", ""))

    def add(done: Column, block: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(last, F.lit("\n\n"), block)
        fits = (F.size(done) > 0) & (shown(joined) <= limit)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(block)))

    return F.aggregate(F.filter(F.split(c, "\n\n"), lambda b: F.trim(b) != ""), F.array().cast("array<string>"), add)
