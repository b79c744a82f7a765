"""Sources of records. Each reader gives a DataFrame and reads lazily through Spark, so any store Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import camel_case
from docweave.operators.rules import source_kind


def files(spark: SparkSession, folder: str, depth: int = 6) -> DataFrame:
    """(path, kind, length) of all files below a folder but those in dot folders, ``__MACOSX`` and deeper than ``depth``.

    Only file listings are read: without ``content`` in the query, no bytes are.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    inner = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    rest = F.substring(inner, F.lit(len(base) + 1), F.length(inner))
    return found.where(~rest.rlike(r"(^|/)(\.|__MACOSX(/|$))") & (F.size(F.split(rest, "/")) <= depth + 1)).withColumn("kind", source_kind(F.col("path")))


def json_records(spark: SparkSession, path: str, unwrap: str = "applicant") -> DataFrame:
    """(path, data): one record a JSON file, as a map of strings; a record inside ``unwrap`` is taken out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    outer = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.element_at(outer, unwrap), "map<string,string>")
    return raw.select("path", F.coalesce(inner, outer).alias("data"))


def parse_lino(c: Column) -> Column:
    """A map from lines ``key "value"``; lone parentheses and other lines are passed over, the last of equal keys counts."""
    pattern = r'^\s*([A-Za-z_][\w-]*)\s+(?:"((?:[^"\\]|\\.)*)"|(\S+))\s*\)?\s*$'
    lines = F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit(pattern)))
    value = lambda x: F.when(F.regexp_extract(x, pattern, 3) != "", F.regexp_replace(F.regexp_extract(x, pattern, 3), r"\)$", "")).otherwise(F.replace(F.regexp_extract(x, pattern, 2), F.lit('\\"'), F.lit('"')))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), value(x).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]), -1))))


def lino_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, data): one record a file in links notation."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", parse_lino(F.col("value")).alias("data"))


def rename_keys(data: Column, aliases: dict[str, str]) -> Column:
    """A record's keys by ``aliases`` (lower case, spaces as underscores), others in camel case; keys that start with an underscore stay."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    key = lambda k: F.replace(F.lower(F.trim(k)), F.lit(" "), F.lit("_"))
    new = lambda k: F.when(k.startswith("_"), k).otherwise(F.coalesce(F.element_at(table, key(k)), camel_case(F.trim(k))))
    pairs = F.transform(F.map_entries(data), lambda e: F.struct(new(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.transform(F.filter(pairs, lambda p: p["key"] == n), lambda p: p["value"]), -1))))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def values_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): one a line, without blank lines and those that start with ``#``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


WORD_BOXES = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, w, h, conf, text) of a reader's tab-separated words; blank words and negative confidence are left out."""
    rows = spark.read.schema(WORD_BOXES).option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    return rows.where((F.trim("text") != "") & (F.col("conf") >= 0)).select(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), "conf", "text")


def web_safe_bytes(c: Column) -> Column:
    """Bytes of URL-safe base64."""
    return F.unbase64(F.translate(c, "-_", "+/"))


def message_id(raw: Column) -> Column:
    """The Message-ID of a mail's header, which ends at the first empty line."""
    header = F.regexp_extract(raw, r"(?s)^(.*?)(?:\r?\n\r?\n|\z)", 1)
    return F.nullif(F.trim(F.regexp_extract(header, r"(?im)^message-id:[ \t]*(.+?)[ \t]*\r?$", 1)), F.lit(""))


def last_json_line(output: Column, schema: str) -> Column:
    return F.from_json(F.element_at(F.split(F.rtrim(output), "\n"), -1), schema)


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """(image, expected) of a case file {baseDir, cases: [{image, expected}]}."""
    schema = "baseDir string, cases array<struct<image:string,expected:map<string,string>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.image", "c.expected")


def transcripts(spark: SparkSession, folder: str, pattern: str = r"([^/]+?)-([a-z]+)-(ocr|visual|text)\.json$") -> DataFrame:
    """(entity, doc_type, layer, field, value) of JSON files named ``entity-type-layer.json``."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("path"), "value")
    named = raw.select(*[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("entity", "doc_type", "layer"))], F.from_json("value", "map<string,string>").alias("data"))
    return named.where("entity <> ''").select("entity", "doc_type", "layer", F.explode("data").alias("field", "value"))
