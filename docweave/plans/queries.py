"""Queries over the driver's tables, each with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import dates, extract, mrz, text
from docweave.operators import addresses, contacts, forms, home_address, matching, order, pages, passport, patterns, reconcile, rules, spatial, wording
from docweave.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, tasks: int = 96) -> DataFrame:
    """A table of short rows dealt out over ``tasks``: its file may be one task to Spark, however much each row asks for."""
    return table(spark, sf_dir, name).repartition(tasks, key)


# Reconciliation


@query("""
WITH s AS (SELECT o_orderkey AS entity, o_orderstatus AS v FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem)
SELECT entity, 'status' AS field, count(v) FILTER (v <> '') AS present,
       CASE WHEN count(v) FILTER (v <> '') < 2 THEN 'INFO' WHEN count(DISTINCT upper(v)) = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM s GROUP BY entity""")
def q_compare(spark, sf_dir):
    """Do an order and its lines tell the same status?"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("value"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linestatus").alias("value"))
    return reconcile.compare(o.unionByName(li).withColumn("field", F.lit("status")), text.letters_key)


@query("""
WITH s AS (SELECT o_orderkey AS entity, o_orderstatus AS v FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem),
c AS (SELECT entity, CASE WHEN count(v) < 2 THEN 'INFO' WHEN count(DISTINCT v) = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM s GROUP BY entity),
p AS (SELECT o_orderpriority AS priority, status FROM c LEFT JOIN orders ON entity = o_orderkey)
SELECT priority, count(*) AS checks, count(*) FILTER (status = 'MATCH') AS matches, count(*) FILTER (status = 'MISMATCH') AS mismatches FROM p GROUP BY ROLLUP (priority)""")
def q_mismatch_summary(spark, sf_dir):
    """Checks by priority with a grand total."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("priority"))
    return reconcile.mismatch_summary(q_compare(spark, sf_dir).join(o, "entity", "left"), "priority")


def _readings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.lit("type").alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("ordinal"),
        F.when(F.col("value") > 50, 2).otherwise(1).alias("weight"))


@query("""
WITH g AS (SELECT user_id AS entity, event_type AS v, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL),
m AS (SELECT entity, max(votes) AS most, count(*) AS candidates FROM g GROUP BY entity),
t AS (SELECT m.*, count(*) AS leaders, min(v) AS v FROM m JOIN g ON g.entity = m.entity AND g.votes = m.most GROUP BY ALL)
SELECT entity, 'type' AS field, CASE WHEN most >= 2 AND leaders = 1 THEN 'agreed' ELSE 'disputed' END AS status,
       CASE WHEN most >= 2 AND leaders = 1 THEN v END AS value, CASE WHEN most >= 2 AND leaders = 1 THEN most END AS votes, candidates FROM t""")
def q_vote(spark, sf_dir):
    """The event type that most of a user's events agree on; ties stay disputed."""
    return reconcile.consensus(reconcile.tally(_readings(spark, sf_dir)))


@query("""
WITH g AS (SELECT user_id AS entity, event_type AS v, sum(CASE WHEN value > 50 THEN 2 ELSE 1 END)::BIGINT AS w FROM events GROUP BY ALL),
m AS (SELECT entity, max(w) AS most, count(*) AS n FROM g GROUP BY entity),
t AS (SELECT m.*, count(*) AS leaders, min(v) AS v FROM m JOIN g ON g.entity = m.entity AND g.w = m.most GROUP BY ALL),
s AS (SELECT *, CASE WHEN most >= 2 AND leaders = 1 THEN 'agreed' WHEN n = 1 THEN 'weak' ELSE 'disputed' END AS status FROM t)
SELECT entity, 'type' AS field, status, CASE WHEN status <> 'disputed' THEN v END AS value, CASE WHEN status <> 'disputed' THEN most END AS votes FROM s""")
def q_settle(spark, sf_dir):
    """Weighted votes on a user's event type."""
    return reconcile.settle(_readings(spark, sf_dir))


@query("""
WITH g AS (SELECT user_id AS entity, event_type AS value, count(*) AS n FROM events GROUP BY ALL)
SELECT entity, arg_min(value, (-n, value)) AS value, max(n) AS top, sum(n)::BIGINT AS total, (max(n) >= 0.35 * sum(n) AND max(n) >= 2) AS accepted FROM g GROUP BY entity""")
def q_plurality(spark, sf_dir):
    """A user's most frequent event type, accepted at a share of 35 %."""
    return reconcile.plurality(_readings(spark, sf_dir))


@query("""
WITH g AS (SELECT user_id AS entity, event_type AS value, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT entity, max(n) AS n FROM g GROUP BY entity)
SELECT m.entity, CASE WHEN count(*) = 1 THEN min(value) END AS value, m.n FROM m JOIN g ON g.entity = m.entity AND g.n = m.n GROUP BY m.entity, m.n""")
def q_unique_mode(spark, sf_dir):
    """A user's most frequent event type, null for ties."""
    return reconcile.unique_mode(_readings(spark, sf_dir))


@query("""
WITH r AS (SELECT user_id AS entity, event_type AS value, event_id AS ordinal, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events)
SELECT entity, arg_min(value, ordinal) AS value, min(ordinal) AS ordinal FROM r WHERE nth = 2 GROUP BY entity""")
def q_early_stop(spark, sf_dir):
    """The event type that a user first repeats."""
    return reconcile.first_repeated(_readings(spark, sf_dir))


@query("""
WITH s AS (SELECT doc_id AS entity, lang AS value, 'documents' AS source, 1 AS o FROM documents UNION ALL SELECT doc_id, CASE WHEN quality = 0 THEN 'poor' ELSE '' END, 'labels', 2 FROM labels
  UNION ALL SELECT item_id, text, 'benchmark', 3 FROM benchmark)
SELECT entity, 'tag' AS field, arg_max(value, o) AS value, arg_max(source, o) AS source FROM s WHERE value IS NOT NULL AND value <> '' GROUP BY entity""")
def q_merge(spark, sf_dir):
    """A tag per id from three sources, the last that has one, with its provenance."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.col("lang").alias("value"), F.lit("documents").alias("source"), F.lit(1).alias("ordinal"))
    la = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity"), F.when(F.col("quality") == 0, "poor").otherwise("").alias("value"), F.lit("labels").alias("source"), F.lit(2).alias("ordinal"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.col("text").alias("value"), F.lit("benchmark").alias("source"), F.lit(3).alias("ordinal"))
    return reconcile.merge_sources(d.unionByName(la).unionByName(b).withColumn("field", F.lit("tag")))


@query("""
WITH a AS (SELECT s_suppkey AS entity, s_nationkey::VARCHAR AS va FROM supplier), b AS (SELECT c_custkey AS entity, c_nationkey::VARCHAR AS vb FROM customer)
SELECT entity, 'nation' AS field, CASE WHEN va IS NULL OR vb IS NULL THEN 'single' WHEN va = vb THEN 'confirmed' ELSE 'conflicting' END AS status,
       CASE WHEN va IS NULL OR vb IS NULL OR va = vb THEN coalesce(va, vb) END AS value FROM a FULL JOIN b USING (entity)""")
def q_crosscheck(spark, sf_dir):
    """Nation of suppliers against that of customers with the same key."""
    zone = lambda t, k, v: table(spark, sf_dir, t).select(F.col(k).alias("entity"), F.lit("nation").alias("field"), F.col(v).cast("string").alias("value"))
    return reconcile.crosscheck(zone("supplier", "s_suppkey", "s_nationkey"), zone("customer", "c_custkey", "c_nationkey"))


@query("""
WITH r AS (SELECT event_type AS reader, (value > 20)::INT AS correct, 1 AS attempted, CASE WHEN value > 150 THEN 'slow' END AS error, value AS ms FROM events)
SELECT reader, sum(correct)::BIGINT AS correct, sum(attempted)::BIGINT AS attempted, sum(correct) / sum(attempted) AS accuracy, count(*) FILTER (correct = attempted) AS perfect, count(*) AS images,
       count(error) AS errors, list_sort(list(ms))[count(*) // 2 + 1] AS median_ms, round(sum(ms), 2) AS total_ms FROM r GROUP BY reader""")
def q_bench(spark, sf_dir):
    """Accuracy and upper median per reader."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_type").alias("reader"), (F.col("value") > 20).cast("int").alias("correct"), F.lit(1).alias("attempted"), F.when(F.col("value") > 150, "slow").alias("error"), F.col("value").alias("ms"))
    return reconcile.reader_summary(r).withColumn("total_ms", F.round("total_ms", 2))


# Joins


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k AS key, 'left' AS side FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'right' FROM o WHERE k NOT IN (SELECT k FROM c)""")
def q_unpaired(spark, sf_dir):
    """Customers in credit without a large order, and large orders' customers who aren't in credit."""
    c, o = table(spark, sf_dir, "customer").where("c_acctbal > 0"), table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return matching.unpaired(c.withColumnRenamed("c_custkey", "key"), o.withColumnRenamed("o_custkey", "key"), "key")


@query("""SELECT c_custkey, c_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def q_paired(spark, sf_dir):
    """Customers with their orders."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return matching.pair(c, o, "c_custkey").groupBy("c_custkey", "c_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT l_partkey AS entity, bool_or(l_returnflag = 'A') AS "has_A", bool_or(l_returnflag = 'N') AS "has_N", bool_or(l_returnflag = 'R') AS "has_R",
       concat_ws(',', CASE WHEN NOT bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN NOT bool_or(l_returnflag = 'N') THEN 'N' END, CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'R' END) AS missing
FROM lineitem GROUP BY l_partkey""")
def q_presence(spark, sf_dir):
    """Which return flags each part's lines have."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("kind"))
    return matching.presence(li, ["A", "N", "R"])


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE levenshtein(a.n_name, b.n_name) <= 1""")
def q_fuzzy(spark, sf_dir):
    """Nation names within one edit, by variants rather than all pairs."""
    n = table(spark, sf_dir, "nation")
    return matching.within_one_edit(n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b")), "a", "b")


@query("""
WITH d AS (SELECT DISTINCT lpad(p_partkey::VARCHAR, 4, '0') AS needle FROM part UNION SELECT p_type FROM part), n AS (SELECT DISTINCT c_name || ' ' || c_mktsegment AS name FROM customer)
SELECT needle, min(name) AS name FROM d JOIN n ON contains(name, needle) GROUP BY needle HAVING count(*) = 1""")
def q_unique_sub(spark, sf_dir):
    """Numbers and types of all parts that just one customer's name and segment contains; some are in several, some in none."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    numbers = p.select(F.lpad(F.col("p_partkey").cast("string"), 4, "0").alias("needle")).unionByName(p.select(F.col("p_type").alias("needle")))
    return matching.unique_contains(numbers, c.select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("name")).distinct())


@query("""
SELECT w.needle, p_name AS name, count(*) AS parts FROM part JOIN (SELECT DISTINCT substr(p_name, 1 + p_size % 5, 1 + p_size % 6) AS needle FROM part) w ON contains(p_name, w.needle) WHERE w.needle <> '' GROUP BY ALL""")
def q_contains(spark, sf_dir):
    """Pieces of one to six letters of part names, and how many parts of each name hold them."""
    p = table(spark, sf_dir, "part")
    pieces = p.select(F.expr("substr(p_name, 1 + p_size % 5, 1 + p_size % 6)").alias("needle"))
    return matching.containing(pieces, p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("parts")))


@query("""
WITH a AS (SELECT doc_id AS entity, quality::VARCHAR AS was FROM labels), b AS (SELECT doc_id AS entity, CASE WHEN toxic = 1 THEN 'toxic' ELSE quality::VARCHAR END AS now FROM labels UNION ALL SELECT item_id + 1000000, 'new' FROM benchmark)
SELECT entity, 'label' AS field, coalesce(was, '') AS was, coalesce(now, '') AS now FROM a FULL JOIN b USING (entity) WHERE coalesce(was, '') <> coalesce(now, '')""")
def q_diff(spark, sf_dir):
    """What changed between two snapshots of labels."""
    la, b = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    before = la.select(F.col("doc_id").alias("entity"), F.lit("label").alias("field"), F.col("quality").cast("string").alias("value"))
    after = la.select(F.col("doc_id").alias("entity"), F.lit("label").alias("field"), F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("quality").cast("string")).alias("value"))
    return matching.changes(before, after.unionByName(b.select((F.col("item_id") + 1000000).alias("entity"), F.lit("label").alias("field"), F.lit("new").alias("value"))))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN ' ' || substr(p_type, 1, 3) WHEN 2 THEN substr(p_type, 2, 3) ELSE p_name END AS value FROM part),
o(o) AS (VALUES ('ECONOMY'), ('Small'), ('medium'), ('LARGE'), ('Promo'), ('STANDARD'), ('Standby'), ('red')),
h AS (SELECT p_partkey, value, lower(trim(value)) AS v, max(o) FILTER (lower(o) = v) AS same, CASE v WHEN 'hot gear' THEN 'red' WHEN 'sta' THEN 'STANDARD' END AS word, count(*) FILTER (contains(lower(o), v)) AS n, max(o) FILTER (contains(lower(o), v)) AS inside,
  count(*) FILTER (starts_with(lower(o), v)) AS s, max(o) FILTER (starts_with(lower(o), v)) AS starts FROM p, o GROUP BY ALL)
SELECT p_partkey, value, coalesce(same, word, CASE WHEN n = 1 THEN inside END, CASE WHEN s = 1 THEN starts END, value) AS canonical FROM h""")
def q_canonical(spark, sf_dir):
    """Types of all parts in other case, cut, or replaced by the part's name, as a site's choices write them."""
    k, kind = F.col("p_partkey") % 4, F.col("p_type")
    value = F.when(k == 0, F.lower(kind)).when(k == 1, F.concat(F.lit(" "), F.substring(kind, 1, 3))).when(k == 2, F.substring(kind, 2, 3)).otherwise(F.col("p_name"))
    options = ["ECONOMY", "Small", "medium", "LARGE", "Promo", "STANDARD", "Standby", "red"]
    return matching.canonical(table(spark, sf_dir, "part").select("p_partkey", value.alias("value")), options, {"hot gear": "red", "sta": "STANDARD"})


@query("""SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents""")
def q_dedup(spark, sf_dir):
    """The first document of each text."""
    return matching.first_by_content(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"), "text", "key")


@query("""
SELECT s_suppkey, x, y, scale, mode, s_suppkey * 1000 + x * 100 + y * 10 + scale AS setting FROM supplier, unnest([-2, -1, 0, 1, 2]) a(x), unnest([0, 1]) b(y), unnest([1.0::DOUBLE, 1.5::DOUBLE]) c(scale), unnest(['plain', 'contrast']) d(mode)""")
def q_grid(spark, sf_dir):
    """Every setting of a reader for each supplier, as rows."""
    rows = matching.grid(table(spark, sf_dir, "supplier").select("s_suppkey"), x=[-2, -1, 0, 1, 2], y=[0, 1], scale=[1.0, 1.5], mode=["plain", "contrast"])
    return rows.withColumn("setting", F.col("s_suppkey") * 1000 + F.col("x") * 100 + F.col("y") * 10 + F.col("scale"))


@query("""
WITH s AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id FROM s WHERE n = 1 AND user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def q_new_only(spark, sf_dir):
    """The first event of each user that isn't known yet."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return matching.new_by(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), known, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("""
SELECT doc_id, array_to_string(list_filter(['the', 'ZUR', 'señor', '@mail'], lambda x: contains(lower(text), lower(x))), ',') AS hits FROM documents""")
def q_contained(spark, sf_dir):
    """Which of some values each document contains."""
    d = matching.which_contain(table(spark, sf_dir, "documents"), ["the", "ZUR", "señor", "@mail"])
    return d.select("doc_id", F.array_join("hits", ",").alias("hits"))


# Rules


@query("""
WITH m AS (SELECT page_id, url AS sender, CASE WHEN page_id % 3 = 0 THEN 'Flight cancelled' WHEN page_id % 3 = 1 THEN 'Big sale' ELSE 'Your e-ticket' END AS subject FROM pages),
f AS (SELECT *, regexp_matches(sender, 'travel|tickets?|booking|reservation|eticket|itinerary|\\.org/') AS known, page_id % 3 = 0 AS change, page_id % 3 = 2 AS support, page_id % 3 = 1 AS promo, contains(sender, 'spam-farm') AS own,
  regexp_matches(sender, 'redditmail\\.com$|reddit\\.com$|facebook|instagram|twitter|linkedin|x\\.com$|newsletter|noreply@medium|digest') AS noise FROM m)
SELECT page_id, CASE WHEN own OR noise THEN -100 ELSE 3 * known::INT + 3 * change::INT + support::INT - 4 * promo::INT END AS score, (NOT own AND NOT noise AND NOT promo AND known AND (change OR support)) AS relevant,
       CASE WHEN own THEN 'from self' WHEN noise THEN 'other sender' ELSE concat_ws('; ', CASE WHEN known THEN 'airline or agent sender' END, CASE WHEN change THEN 'cancellation or change subject' END,
       CASE WHEN support THEN 'supporting subject' END, CASE WHEN promo THEN 'promotional subject' END) END AS reasons FROM f""")
def q_curate(spark, sf_dir):
    """Page urls scored as senders of messages."""
    subject = F.when(F.col("page_id") % 3 == 0, "Flight cancelled").when(F.col("page_id") % 3 == 1, "Big sale").otherwise("Your e-ticket")
    v = rules.score_message(F.col("url"), subject, own=["spam-farm"], senders=["travel|tickets?|booking|reservation|eticket|itinerary", r"\.org/"])
    return table(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", "v.score", "v.relevant", F.array_join("v.reasons", "; ").alias("reasons"))


EMAIL, PHONE = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\+[0-9][0-9 -]{6,}[0-9]"
#: ``EMAIL`` for Java: a name is tried from its first letter only and given up at once, so long words cost no more than short ones.
EMAIL_ONCE = r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


@query(f"""
WITH a AS (SELECT doc_id, text, len(regexp_extract_all(text, '{EMAIL}')) AS n, regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g') AS t FROM documents)
SELECT doc_id, regexp_replace(t, '{PHONE}', '[REDACTED]', 'g') AS text, (n + len(regexp_extract_all(t, '{PHONE}')))::INT AS removed FROM a""")
def q_redact(spark, sf_dir):
    """Documents without e-mail addresses and phone numbers."""
    r = rules.redact_patterns(F.col("text"), [EMAIL_ONCE, PHONE])
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.text", "r.removed")


@query("""
WITH a AS (SELECT doc_id, regexp_replace(text, 'licensed under', '[REDACTED]', 'gi') AS t, len(regexp_extract_all(text, 'licensed under', 0, 'i')) AS n FROM documents)
SELECT doc_id, md5(regexp_replace(t, 'THE', '[REDACTED]', 'gi')) AS digest, (n + len(regexp_extract_all(t, 'THE', 0, 'i')))::INT AS removed FROM a""")
def q_redact_values(spark, sf_dir):
    """Documents without some values, whatever their case."""
    r = rules.redact_values(F.col("text"), ["THE", "licensed under"])
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", F.md5("r.text").alias("digest"), "r.removed")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<iframe\b[^>]*>.*?</iframe\s*>', '', 'gis'), '<object\b[^>]*>.*?</object\s*>', '', 'gis'),
  '<(frame|embed)\b[^>]*>.*?</(frame|embed)\s*>', '', 'gis'), '</?(script|iframe|frame|object|embed)\b[^>]*>', '', 'gis') AS h FROM pages),
t AS (SELECT page_id, list_transform(regexp_extract_all(h, '<(?:[^<>"'']+|"[^"]*"|''[^'']*'')*>|<[^<>]*>|[^<]+|<'), lambda x: CASE WHEN NOT regexp_matches(x, '^<[A-Za-z]') THEN x WHEN regexp_matches(x, '^<meta\b.*http-equiv\s*=\s*["'']?refresh', 'i') THEN ''
  ELSE regexp_replace(regexp_replace(x, '\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', '', 'gi'), '\b(href|src|action)\s*=\s*("\s*javascript:[^"]*"|''\s*javascript:[^'']*''|javascript:[^\s>]*)', '\1="#"', 'gi') END) AS x FROM a)
SELECT page_id, md5(array_to_string(x, '')) AS digest FROM t""")
def q_strip(spark, sf_dir):
    """Pages without active content."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(rules.strip_active_content(F.col("html"))).alias("digest"))


@query("""
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 400000 THEN 'total is too high' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'priority is no choice' END,
       CASE WHEN length(o_orderstatus) > 1 THEN 'status is longer than 1' END, CASE WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN 'date is to come' END) AS errors,
       NOT (o_totalprice > 400000 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR length(o_orderstatus) > 1 OR o_orderdate > TIMESTAMP '2000-01-01') AS valid FROM orders""")
def q_validate(spark, sf_dir):
    """All messages of the rules that an order breaks."""
    o = table(spark, sf_dir, "orders")
    listed = rules.schema_rules([{"id": "o_orderpriority", "options": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, {"id": "o_orderstatus", "max": 1}])
    named = [(m.replace("o_orderpriority", "priority").replace("o_orderstatus", "status"), c) for m, c in listed]
    checked = rules.validate(o, [("total is too high", F.col("o_totalprice") > 400000), *named, ("date is to come", F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp_ntz"))])
    return checked.select("o_orderkey", F.array_join("errors", "; ").alias("errors"), "valid")


@query("""
SELECT page_id, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) WHEN 'json' THEN 'json' WHEN 'lino' THEN 'lino' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'heic' THEN 'image'
  WHEN 'pdf' THEN 'pdf' WHEN 'zip' THEN 'archive' ELSE 'unknown' END AS kind,
  CASE WHEN regexp_matches(n, 'photo|portrait|headshot') AND NOT contains(n, 'passport') THEN 'portrait' WHEN contains(n, 'passport') THEN 'passport' WHEN contains(n, 'visa') THEN 'visa' ELSE 'unknown' END AS role,
  (regexp_matches(url, '/en/') AND NOT regexp_matches(url, '\\.(png|jpe?g|gif|pdf|zip|gz|woff2?|ico|mp4|webp)$') AND NOT regexp_matches(url, '(^|/)[^/]*\\.html$')) AS searched
FROM (SELECT page_id, url, lower(regexp_extract(url, '([^/]*)/*$', 1)) AS n FROM pages)""")
def q_classify(spark, sf_dir):
    """Kind, role and choice of page urls taken as files."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", rules.source_kind(u).alias("kind"), rules.document_role(u).alias("role"), rules.chosen_file(u, ["**/en/**"], ["*.html"]).alias("searched"))


# Scalars


@query("""
WITH k AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0') AS s FROM orders)
SELECT o_orderkey, s, (list_sum([(ord(s[i]) - 48) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, 10)]) % 10)::INT AS digit FROM k""")
def q_check_digit(spark, sf_dir):
    """Check digits of order numbers."""
    s = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), mrz.check_digit(s).alias("digit"))


def _digit_sql(x: str) -> str:
    return "((" + " + ".join(f"{w} * substr({x}, {i}, 1)::INT" for i, w in enumerate((7, 3, 1, 7, 3, 1), 1)) + ") % 10)"


def _date_sql(x: str) -> str:
    return f"(substr({x}, 3, 2)::INT BETWEEN 1 AND 12 AND substr({x}, 5, 2)::INT BETWEEN 1 AND 31)"


@query(f"""
WITH g(glyph, others) AS (VALUES ('1', '74'), ('7', '1'), ('8', '635'), ('9', '48'), ('0', '86'), ('5', '68'), ('6', '58'), ('4', '19'), ('3', '8'), ('2', '7')),
c AS (SELECT c_custkey AS k, c_mktsegment AS seg, strftime(DATE '1950-01-01' + (c_custkey * 37 % 18000)::INT, '%y%m%d') AS t, 1 + c_custkey % 6 AS p, 1 + c_custkey % 5 AS q FROM customer),
m AS (SELECT c.*, {_digit_sql("t")} AS d, CASE WHEN k % 4 = 0 THEN t ELSE substr(t, 1, p - 1) || substr(a.others, 1, 1) || substr(t, p + 1) END AS v1 FROM c JOIN g a ON a.glyph = substr(t, p, 1)),
v AS (SELECT m.*, CASE WHEN k % 4 = 2 THEN substr(v1, 1, q - 1) || substr(b.others, 1, 1) || substr(v1, q + 1) ELSE v1 END AS v FROM m JOIN g b ON b.glyph = substr(v1, q, 1)),
r AS (SELECT k, v, d, i, a FROM (SELECT k, v, d, i, unnest(string_split(others, '')) AS a FROM (SELECT k, v, d, unnest([1, 2, 3, 4, 5, 6]) AS i FROM v) JOIN g ON glyph = substr(v, i, 1))),
one AS (SELECT k, substr(v, 1, i - 1) || a || substr(v, i + 1) AS w, d FROM r), two AS (SELECT x.k, substr(x.v, 1, x.i - 1) || x.a || substr(x.v, x.i + 1, y.i - x.i - 1) || y.a || substr(x.v, y.i + 1) AS w, x.d FROM r x JOIN r y ON x.k = y.k AND x.i < y.i),
n1 AS (SELECT k, count(DISTINCT w) AS n, min(w) AS w FROM one WHERE {_digit_sql("w")} = d AND {_date_sql("w")} GROUP BY k), n2 AS (SELECT k, count(DISTINCT w) AS n, min(w) AS w FROM two WHERE {_digit_sql("w")} = d AND {_date_sql("w")} GROUP BY k),
f AS (SELECT v.*, CASE WHEN {_digit_sql("v")} = d THEN v WHEN n1.n = 1 THEN n1.w WHEN n1.n > 1 THEN v WHEN n2.n = 1 THEN n2.w ELSE v END AS x, {_digit_sql("v")} <> d AND (coalesce(n1.n, 0) = 1 OR (n1.n IS NULL AND coalesce(n2.n, 0) = 1)) AS repaired
  FROM v LEFT JOIN n1 ON n1.k = v.k LEFT JOIN n2 ON n2.k = v.k)
SELECT k AS c_custkey, upper(seg) AS surname, lpad(k::VARCHAR, 9, '0') AS number, k % 5 <> 0 AS number_ok, (CASE WHEN substr(x, 1, 2)::INT <= 30 THEN '20' ELSE '19' END) || substr(x, 1, 2) || '-' || substr(x, 3, 2) || '-' || substr(x, 5, 2) AS birth,
       {_digit_sql("x")} = d AND {_date_sql("x")} AS birth_ok, CASE WHEN repaired THEN 'birth,expiry' ELSE 'expiry' END AS repaired, 'F' AS sex, '2031-02-28' AS expiry FROM f""")
def q_mrz(spark, sf_dir):
    """Lines built of all customers, some with a wrong digit and with one or two glyphs of a date misread, parsed and repaired."""
    k, number, expiry = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("310228")
    wrong = F.create_map(*[F.lit(x) for kv in {g: o.replace(g, "")[:1] for g, o in mrz.AMBIGUOUS.items() if g.isdigit()}.items() for x in kv])
    misread = lambda v, at: F.concat(F.substring(v, F.lit(1), at - 1), F.element_at(wrong, F.substring(v, at, F.lit(1))), F.substring(v, at + 1, F.lit(9)))
    c = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_mktsegment", F.expr("date_format(date_add(DATE'1950-01-01', CAST(c_custkey * 37 % 18000 AS INT)), 'yyMMdd')").alias("t"))
    c = c.withColumn("v", F.when(k % 4 == 0, F.col("t")).otherwise(misread(F.col("t"), (1 + k % 6).cast("int"))))
    c = c.withColumn("v", F.when(k % 4 == 2, misread(F.col("v"), (1 + k % 5).cast("int"))).otherwise(F.col("v")))
    digit = (mrz.check_digit(number) + F.when(k % 5 == 0, 1).otherwise(0)) % 10
    line1 = F.rpad(F.concat(F.lit("P<UTO"), F.upper("c_mktsegment"), F.lit("<<ANN<MARIE")), 44, "<")
    line2 = F.concat(number, digit, F.lit("UTO"), F.col("v"), mrz.check_digit(F.col("t")), F.lit("F"), F.translate(expiry, "0", "O"), mrz.check_digit(expiry), F.lit("<<<<<<<<<<<<<<00"))
    read = mrz.parse_line2(c.select("c_custkey", mrz.parse_line1(line1).alias("a"), line2.alias("line2")), "line2", "b")
    return read.select("c_custkey", "a.surname", "b.number", "b.number_ok", "b.birth", "b.birth_ok", F.array_join("b.repaired", ",").alias("repaired"), "b.sex", "b.expiry")


@query("""
SELECT doc_id, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z ]', ' ', 'g'), '\\s+'), lambda w: w <> '')), ' ') AS name_key,
       md5(upper(trim(regexp_replace(regexp_replace(strip_accents(replace(text, 'ß', ' ')), '[^A-Za-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')))) AS plain FROM documents""")
def q_name_key(spark, sf_dir):
    """Sorted words, and plain capitals, of the whole texts of all documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.name_key(F.col("text")).alias("name_key"), F.md5(text.normal_name(F.col("text"))).alias("plain"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Shchukin Iurii' WHEN 1 THEN 'ZHANNA ANNA' WHEN 2 THEN 'Kharkov ' || n_nationkey ELSE n_name END AS value, n_nationkey % 4 <> 3 AS transliterated FROM nation""")
def q_translit(spark, sf_dir):
    """Names in Latin letters."""
    k = F.col("n_nationkey") % 4
    source = F.when(k == 0, "Щукин Юрий").when(k == 1, "ЖАННА ANNA").when(k == 2, F.concat(F.lit("Харьков "), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.to_latin(source).alias("r")).select("n_nationkey", "r.value", "r.transliterated")


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y%m%d') AS iso_key, strftime(d, '%Y%m%d') AS named_key, strftime(d, '%Y%m%d') AS dotted_key, strftime(d, '%d/%m/%Y') AS form,
       CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS swapped, datediff('day', d, DATE '2000-01-01') + 1 AS days FROM d""")
def q_dates(spark, sf_dir):
    """Dates in several spellings, read back."""
    d = F.col("o_orderdate").cast("date")
    iso, dotted = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d.M.yyyy")
    named = F.concat_ws("/", F.dayofmonth(d).cast("string"), F.upper(F.date_format(d, "MMM")), F.year(d).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.date_key(iso).alias("iso_key"), dates.date_key(named).alias("named_key"), dates.date_key(dotted).alias("dotted_key"), dates.form_date(dates.parse_date(dotted)).alias("form"),
        dates.parse_date(F.date_format(d, "M/d/yyyy")).alias("swapped"), dates.inclusive_days(dates.parse_date(F.date_format(d, "d MMMM yyyy")), F.lit("2000-01-01").cast("date")).cast("long").alias("days"))


@query("""
SELECT conv_id, turn, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, CASE WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS language FROM conversations""")
def q_messages(spark, sf_dir):
    """Messages escaped, with the language of their letters."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.escape_html(F.col("text"))).alias("escaped"), text.language_of(F.col("text")).alias("language"))


@query("""SELECT event_id, event_type AS type, (props::JSON ->> 'k')::INT AS k, 'type: ' || event_type AS first_label FROM events""")
def q_labelled(spark, sf_dir):
    """Label and value pairs of lines whose columns stand apart."""
    line = F.concat(F.lit("type: "), "event_type", F.lit("    k : "), F.get_json_object("props", "$.k"), F.lit("     type: other"))
    e = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("line_no"), line.alias("line"))
    found = order.labelled_values(e, "event_id", "line_no", "line")
    flat = found.groupBy("event_id").agg(F.max(F.when(F.col("label") == "type", F.col("value"))).alias("type"), F.max(F.when(F.col("label") == "k", F.col("value"))).cast("int").alias("k"))
    return flat.select("*", F.concat(F.lit("type: "), "type").alias("first_label"))


@query("""
SELECT c_custkey, 'E' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || 'ABC1' AS number, 'c' || c_custkey || '@mail.example.org' AS email,
       CASE WHEN c_nationkey < 12 THEN lpad((c_nationkey + 1)::VARCHAR, 2, '0') || '/05/1990' ELSE (c_nationkey + 1) || '/05/1990' END AS birth FROM customer""")
def q_lookup(spark, sf_dir):
    """Number, address and birth found in messages, in any order."""
    c = F.col("c_custkey").cast("string")
    said = F.concat(F.lit("born "), (F.col("c_nationkey") + 1).cast("string"), F.lit(".5.1990, mail c"), c, F.lit("@mail.example.org and e"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), F.lit("abc1."))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.lookup_details(said).alias("r")).select("c_custkey", "r.number", "r.email", "r.birth")


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '84' END AS code, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '84' END || lpad(c_custkey::VARCHAR, 9, '9') AS number FROM customer""")
def q_phone(spark, sf_dir):
    """Phone numbers parted from their dialling codes, which only a plus announces."""
    said = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "+84 ").otherwise("84-"), F.lpad(F.col("c_custkey").cast("string"), 9, "9"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.split_phone(said, ["7", "84", "1"]).alias("r")).select("c_custkey", "r.code", "r.number")


@query("""
SELECT c_custkey, c_mktsegment AS purpose, 'air' AS mode, CASE WHEN c_acctbal < 0 THEN 'late' ELSE 'named' END AS status, CASE WHEN c_acctbal < 0 THEN '' ELSE 'email' END AS missing FROM customer""")
def q_declaration(spark, sf_dir):
    """A target form's values and what it still needs."""
    given = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("status"), F.lit("named"), F.lit("mode"), F.lit(""))
    extra = F.create_map(F.lit("status"), F.when(F.col("c_acctbal") < 0, "late").otherwise(""), F.lit("email"), F.when(F.col("c_acctbal") < 0, "x@y"))
    fields = [{"key": "purpose", "from": "segment"}, {"key": "mode", "fixed": "air"}, {"key": "status"}, {"key": "email"}, {"key": "note", "required": False}]
    r = table(spark, sf_dir, "customer").select("c_custkey", extract.declaration(fields, given, extra).alias("r"))
    value = lambda k: F.element_at("r.values", k).alias(k)
    return r.select("c_custkey", value("purpose"), value("mode"), value("status"), F.array_join("r.missing", ",").alias("missing"))


@query("""
SELECT c_custkey AS doc, 'VN' || lpad((c_custkey % 900 + 100)::VARCHAR, 3, '0') AS flight, lpad((c_nationkey % 28 + 1)::VARCHAR, 2, '0') || '/09/2026' AS arrival, 'Delhi' AS departed_from FROM customer""")
def q_ticket(spark, sf_dir):
    """The arriving flight of itineraries of two legs, whose dates stand on later lines."""
    number, day = F.lpad((F.col("c_custkey") % 900 + 100).cast("string"), 3, "0"), (F.col("c_nationkey") % 28 + 1).cast("string")
    lines = F.array(
        F.lit("BOOKING REFERENCE: X"), F.lit("Delhi    Bangkok  AI332"), F.lit("economy"), F.lit("seat 1"), F.lit("none"), F.lit("none"),
        F.concat(F.lit("Bangkok    HANOI (Viet Nam)  VN"), number), F.lit("economy"), F.concat(F.lit("departs "), day, F.lit("Sep2026")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(lines).alias("line_no", "line"))
    return extract.ticket_fields(extract.ticket_legs(rows))


# Order


@query("""
SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS ahead FROM conversations""")
def q_legs(spark, sf_dir):
    """Each turn with the three that follow."""
    return order.look_ahead(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("ahead").alias("ahead"))


@query("""
WITH a AS (SELECT user_id, event_id, event_type, (lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type)::INT AS s FROM events),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM b GROUP BY user_id, run""")
def q_islands(spark, sf_dir):
    """Runs of equal event types per user."""
    return order.islands(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
f AS (SELECT *, trim(regexp_replace(line, '\\s', ' ', 'g')) = '' AS blank FROM e),
g AS (SELECT *, (NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true))::INT AS opens FROM f),
h AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block FROM g WHERE true)
SELECT doc_id, block::BIGINT AS block, count(*) AS lines FROM h WHERE NOT blank GROUP BY ALL""")
def q_block(spark, sf_dir):
    """Blocks of lines that blank lines part, over all lines of documents, however long."""
    lines = order.text_lines(table(spark, sf_dir, "documents"))
    return order.blocks(lines, "doc_id", "line_no", "line").groupBy("doc_id", "block").agg(F.count("*").alias("lines"))


@query("""
WITH r AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row, value < 30 AS blank FROM events),
i AS (SELECT *, row - row_number() OVER (PARTITION BY page, blank ORDER BY row) AS g FROM r), j AS (SELECT page, min(row) AS a, max(row) AS b FROM i WHERE blank GROUP BY page, g HAVING count(*) >= 6)
SELECT page, floor((a + b + 1) / 2)::BIGINT AS centre FROM j""")
def q_gaps(spark, sf_dir):
    """Middles of long runs of small values."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.row_number().over(w).alias("row"), (F.col("value") < 30).alias("blank"))
    return order.gap_centres(rows)


@query("""
WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 20 MINUTE, true))::INT AS s FROM events),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM h GROUP BY user_id, run""")
def q_sessions(spark, sf_dir):
    """Sessions of users, parted by twenty quiet minutes."""
    s = order.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "n")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT user_id, max(d) / 1000000 AS seconds FROM g GROUP BY user_id""")
def q_widest_gap(spark, sf_dir):
    """The longest silence of each user."""
    return order.widest_gap(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""
SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS reached,
       min(event_id) FILTER (event_type = 'view') AS at_view, min(event_id) FILTER (event_type = 'click') AS at_click, min(event_id) FILTER (event_type = 'signup') AS at_signup, min(event_id) FILTER (event_type = 'purchase') AS at_purchase FROM events GROUP BY user_id""")
def q_stage(spark, sf_dir):
    """How far each user got, and when."""
    return order.stages_reached(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["view", "click", "signup", "purchase"])


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def q_last_write(spark, sf_dir):
    """The latest value of each user and type."""
    return order.last_write(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "value", "event_id")


@query("""
WITH u AS (SELECT user_id, round(value * 100)::BIGINT % 40 + 1 AS seq, min({'ts': ts, 'event_id': event_id, 'event_type': event_type}) AS f FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS r FROM u)
SELECT user_id, seq, f.event_id AS event_id, f.event_type AS event_type FROM n WHERE seq = r""")
def q_commit(spark, sf_dir):
    """The numbered results of a user that can be committed in order; of one number the earliest counts."""
    e = table(spark, sf_dir, "events").select("user_id", (F.round(F.col("value") * 100).cast("long") % 40 + 1).alias("seq"), "ts", "event_id", "event_type")
    return order.contiguous(e, "user_id", "seq", "ts", "event_id").drop("ts")


@query("""SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY""")
def q_retention(spark, sf_dir):
    """Events past their retention."""
    return order.expired(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 20).select("event_id", "user_id")


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mode_now FROM events""")
def q_mode(spark, sf_dir):
    """The mode a user is in at each event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("mode"))
    return order.mode_at(e, "user_id", ["event_id"], "mode").select("user_id", "event_id", "mode_now")


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, min(event_id) AS at FROM s WHERE p = event_type GROUP BY user_id""")
def q_steady(spark, sf_dir):
    """When a user's event type first repeats at once."""
    return order.steady(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


# Texts of records


@query("""
SELECT c_custkey, '(' || chr(10) || '  nation ' || c_nationkey || chr(10) || '  segment "' || c_mktsegment || '"' || chr(10) || ')' AS lino, c_mktsegment AS segment FROM customer""")
def q_lino(spark, sf_dir):
    """Records written in links notation and read back."""
    data = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("_note"), F.lit("x"))
    lino = writers.to_lino(data)
    return table(spark, sf_dir, "customer").select("c_custkey", lino.alias("lino"), F.element_at(readers.parse_lino(lino), "segment").alias("segment"))


@query("""
WITH s AS (SELECT o_orderkey AS entity, o_orderstatus AS v FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem),
c AS (SELECT entity, CASE WHEN count(v) < 2 THEN 'INFO' WHEN count(DISTINCT v) = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM s GROUP BY entity)
SELECT entity, '# ' || entity || chr(10) || chr(10) || '- ' || CASE status WHEN 'MATCH' THEN '✅' WHEN 'MISMATCH' THEN '❌' ELSE 'ℹ️' END || ' status: ' || status || chr(10) || chr(10) || 'Mismatches: ' || (status = 'MISMATCH')::INT || chr(10) AS markdown FROM c""")
def q_report(spark, sf_dir):
    """A Markdown report per order."""
    return writers.check_report(q_compare(spark, sf_dir))


# Readings of pages


@query("""
WITH c AS (SELECT user_id AS entity, event_type AS word, count(*) AS n, event_type IN ('purchase', 'signup') AS known FROM events GROUP BY ALL),
k AS (SELECT *, bool_or(known) OVER (PARTITION BY entity) AS outranked FROM c), r AS (SELECT * FROM k WHERE known OR NOT outranked), m AS (SELECT entity, max(n) AS most FROM r GROUP BY entity)
SELECT m.entity, CASE WHEN count(*) = 1 AND (most >= 2 OR bool_or(known)) THEN min(word) END AS word FROM m JOIN r ON r.entity = m.entity AND r.n = m.most GROUP BY m.entity, most""")
def q_agreed_word(spark, sf_dir):
    """The event type most of a user's events give, where two types outrank the others."""
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("word"))
    return passport.agreed_word(words, spark.createDataFrame([("purchase",), ("signup",)], "word string"))


@query("""
WITH d AS (SELECT o_custkey AS entity, o_orderdate::DATE AS day, count(*) AS votes FROM orders GROUP BY ALL),
k AS (SELECT entity, CASE WHEN entity % 3 = 0 THEN min(day) END AS birth, CASE WHEN entity % 2 = 0 THEN (min(day) + INTERVAL 10 YEAR)::DATE END AS expiry FROM d GROUP BY entity),
a AS (SELECT entity, day, votes + CASE WHEN strftime(day, '%m-%d') = strftime(expiry, '%m-%d') AND year(expiry) - year(day) IN (5, 10) THEN 2 ELSE 0 END AS votes FROM d JOIN k USING (entity)
  WHERE coalesce(day > birth, true) AND coalesce(day < expiry AND year(day) >= year(expiry) - 10, true) AND day <= DATE '1996-06-30'),
t AS (SELECT entity, max(votes) AS votes FROM a GROUP BY entity)
SELECT entity, min(day) AS issued, votes FROM a JOIN t USING (entity, votes) GROUP BY ALL HAVING count(*) = 1""")
def q_issue_date(spark, sf_dir):
    """A customer's order dates taken as readings of a day of issue."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("votes"))
    least = d.groupBy("entity").agg(F.min("day").alias("day"))
    known = least.select("entity", F.when(F.col("entity") % 3 == 0, F.col("day")).alias("birth"), F.when(F.col("entity") % 2 == 0, F.add_months("day", 120)).alias("expiry"))
    return passport.issue_date(d, known, F.lit("1996-06-30").cast("date"))


@query("""SELECT c_custkey AS entity, 'r' AS reader, (c_custkey % 3 <> 0)::BIGINT + (c_custkey % 5 <> 0)::BIGINT + 1 AS correct, 3::BIGINT AS attempted FROM customer""")
def q_score(spark, sf_dir):
    """Fields read right, of an expected number, date and name."""
    k = F.col("c_custkey")
    field = lambda n, c: F.struct(F.lit(n).alias("field"), c.cast("string").alias("value"))
    rows = lambda *f: table(spark, sf_dir, "customer").select(k.alias("entity"), F.explode(F.array(*f)).alias("f")).select("entity", "f.field", "f.value")
    expected = rows(field("documentNumber", k), field("birthDate", F.lit("1985-07-13")), field("surname", F.col("c_mktsegment")))
    read = rows(field("documentNumber", F.when(k % 3 == 0, (k + 1).cast("string")).otherwise(F.concat(F.lit(" - "), k.cast("string")))), field("birthDate", F.when(k % 5 != 0, "850713")), field("surname", F.concat("c_mktsegment", F.lit("KKK"))))
    return passport.score_readings(read.withColumn("reader", F.lit("r")), expected)


@query("""
WITH h AS (SELECT c_custkey AS entity, c_nationkey::VARCHAR AS held FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT s_suppkey AS entity, s_nationkey::VARCHAR AS got, s_suppkey % 3 = 0 AS printed FROM supplier)
SELECT entity, 'nation' AS field, CASE WHEN printed THEN coalesce(held, got) ELSE coalesce(got, held) END AS value FROM h FULL JOIN r USING (entity) WHERE entity % 7 <> 0""")
def q_keep_read(spark, sf_dir):
    """Nations held for customers with those read for suppliers."""
    held = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity"), F.lit("nation").alias("field"), F.col("c_nationkey").cast("string").alias("value"))
    read = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.lit("nation").alias("field"), F.col("s_nationkey").cast("string").alias("value"), (F.col("s_suppkey") % 3 == 0).alias("printed"))
    disputed = held.select("entity", "field").unionByName(read.select("entity", "field")).where("entity % 7 = 0")
    return passport.keep_read(held, read, disputed)


@query("""
SELECT c_custkey AS doc, rpad('P<UTO' || c_mktsegment || '<<OLGA', 44, '<') AS line1, rpad(lpad(c_custkey::VARCHAR, 9, '0') || '0UTO8507131F3102286<<<<<<00', 44, '<') AS line2 FROM customer WHERE c_custkey % 4 <> 0""")
def q_zone_lines(spark, sf_dir):
    """The zone among a page's lines; where its second line lost a glyph, there is none."""
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    second = F.concat(F.when(F.col("c_custkey") % 4 == 0, F.substring(number, 2, 8)).otherwise(number), F.lit("0uto 8507131 F3102286<<<<<<00"))
    first = F.concat(F.lit("P<UTO"), F.col("c_mktsegment"), F.lit("<<0LGA<<<<<<<<<<<<<<<<<<<<<<"))
    lines = F.array(F.lit("UTOPIA PASSPORT"), second, F.lit("a line that is long enough but says nothing"), first)
    return passport.zone_lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(lines).alias("line_no", "line")))


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ФМС' WHEN 1 THEN 'МВД' END AS body, CASE n_nationkey % 4 WHEN 2 THEN 'Г/К РОССИИ, БЕРЛИН' WHEN 3 THEN 'ПОСОЛЬСТВО РОССИИ, НЬЮ ДЕЛИ' END AS consulate FROM nation""")
def q_authority(spark, sf_dir):
    """Issuing bodies in readings with letters of the wrong alphabet."""
    k = F.col("n_nationkey") % 4
    said = F.when(k == 0, "УФMC 770-001").when(k == 1, "xx MBД").when(k == 2, "Г/К POCCИИ, БЕРЛИН").otherwise("ПОСОЛЬСТБО РОССИИ в Нью Дели Индия")
    return table(spark, sf_dir, "nation").select("n_nationkey", passport.authority_body(said).alias("body"), passport.consular_authority(said).alias("consulate"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Tourist' ELSE c_mktsegment END AS purpose, CASE WHEN c_nationkey = 0 THEN 'No' WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS credit FROM customer""")
def q_defaults(spark, sf_dir):
    """Blank answers with their defaults, booleans as Yes and No."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("purpose"), F.when(F.col("c_nationkey") != 0, F.col("c_acctbal") > 0).alias("credit"))
    return passport.with_defaults(c, {"purpose": "Tourist"}).withColumn("credit", passport.yes_or_no(F.col("credit"), "No"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'contains O' WHEN 3 THEN 'is empty' END AS fault FROM orders""")
def q_date_fault(spark, sf_dir):
    """Texts that can't be dates."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, "O2/O3/199O").when(k == 2, F.date_format(d, "d MMMM yyyy")).otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", passport.date_fault(said).alias("fault"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS place FROM customer""")
def q_between(spark, sf_dir):
    """Values between two labels of a page's text."""
    page = F.concat(F.lit("Name  "), "c_name", F.lit("\nDate of birth 1.1.90 Place:\n"), "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, " Sex F").otherwise(" F"))
    return table(spark, sf_dir, "customer").select("c_custkey", passport.field_between(page, "Name", "Date").alias("name"), passport.field_between(page, "Place:", "Sex").alias("place"))


@query("""
SELECT c_custkey AS entity, 1 AS section, 'segment=' || c_mktsegment || ',name=' || c_name AS fields FROM customer UNION ALL SELECT c_custkey, 99, 'nation=' || c_nationkey FROM customer""")
def q_sections(spark, sf_dir):
    """A record's fields by the parts of a form."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("field", "value"))
    placed = passport.by_section(c, spark.createDataFrame([("name", 1, 2), ("segment", 1, 1)], "field string, section int, place int"))
    return placed.select("entity", "section", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit("="), f["value"])), ",").alias("fields"))


@query("""
SELECT n_name AS source, n_name || '.html' AS target, CASE n_regionkey WHEN 0 THEN 'already named' WHEN 1 THEN 'renamed' ELSE 'missing' END AS outcome FROM nation""")
def q_rename(spark, sf_dir):
    """What becomes of files that a mapping names."""
    n = table(spark, sf_dir, "nation")
    target = F.concat("n_name", F.lit(".html"))
    existing = n.where("n_regionkey < 2").select(F.when(F.col("n_regionkey") == 0, target).otherwise(F.col("n_name")).alias("name"))
    return passport.rename_plan(n.select(F.col("n_name").alias("source"), target.alias("target")), existing)


@query("""SELECT DISTINCT source AS commit, doc_id::VARCHAR AS path FROM documents WHERE (contains(text, 'the.') OR contains(text, 'señor') OR contains(text, '[x]')) AND lang <> 'fr'""")
def q_holding(spark, sf_dir):
    """Documents, but French ones, that hold any of some values, by source."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("commit"), F.col("doc_id").cast("string").alias("path"), "text", "lang")
    return passport.holding(d, ["the.", "señor", "[x]"], F.col("lang") != "fr")


# Wording of people, tickets and sites


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(t, 'бабушк|бабул|grandmother|grandma') THEN 'Grandmother' WHEN regexp_matches(t, 'дедушк|дед[аеу]?([^\p{L}]|$)|grandfather|grandpa') THEN 'Grandfather'
  WHEN regexp_matches(t, 'внучк|granddaughter') THEN 'Granddaughter' WHEN regexp_matches(t, 'внук|grandson') THEN 'Grandson' WHEN regexp_matches(t, 'т[её]т[яеи]|aunt') THEN 'Aunt'
  WHEN regexp_matches(t, 'дяд|uncle') THEN 'Uncle' WHEN regexp_matches(t, 'племянниц|niece') THEN 'Niece' WHEN regexp_matches(t, 'племянник|nephew') THEN 'Nephew' WHEN regexp_matches(t, 'кузен|кузин|двоюродн|cousin') THEN 'Cousin'
  WHEN regexp_matches(t, 'сестр|sister') THEN 'Sister' WHEN regexp_matches(t, 'брат|brother') THEN 'Brother' WHEN regexp_matches(t, 'мам|мать|mother') THEN 'Mother' WHEN regexp_matches(t, 'отец|отц|пап|father') THEN 'Father'
  WHEN regexp_matches(t, 'муж|husband') THEN 'Husband' WHEN regexp_matches(t, 'жен|wife') THEN 'Wife' WHEN regexp_matches(t, 'сын|son([^\p{L}]|$)') THEN 'Son' WHEN regexp_matches(t, 'доч|daughter') THEN 'Daughter'
  WHEN regexp_matches(t, 'партн[её]р|partner') THEN 'Partner' WHEN regexp_matches(t, 'друг|friend') THEN 'Friend' WHEN regexp_matches(t, 'коллег|colleague') THEN 'Colleague' WHEN regexp_matches(t, 'родствен|relative') THEN 'Relative' END AS relationship
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def q_relationship(spark, sf_dir):
    """The relationship that each whole text names first."""
    return table(spark, sf_dir, "documents").select("doc_id", wording.relationship_in(F.col("text")).alias("relationship"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS written FROM orders""")
def q_written_date(spark, sf_dir):
    """Dates written in words of two languages or in digits."""
    months = F.split(F.lit("января февраля марта апреля мая июня июля августа сентября октября ноября декабря"), " ")
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    russian = F.concat_ws(" ", F.dayofmonth(d), F.get(months, F.month(d) - 1), F.year(d), F.lit("года"))
    said = F.when(key % 11 == 0, "17 of no month").when(key % 3 == 0, russian).when(key % 3 == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "d MMMM, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", wording.written_date(F.concat(F.lit("on "), said)).alias("written"))


@query("""
SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 40 YEAR)::DATE AS birth, (o_orderdate::DATE - to_years(CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 5 END))::DATE AS issue, o_orderdate::DATE AS expiry FROM orders""")
def q_assign_dates(spark, sf_dir):
    """Printed dates told apart, with a zone that gives both, one or none of birth and expiry, or one that isn't printed."""
    e, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    ago = lambda years: F.add_months(e, -12 * years)
    printed = F.array(ago(40), ago(8), F.when(key % 5 != 0, ago(5)), e, e)
    found = wording.assign_dates(printed, F.when(key % 2 == 0, ago(40)), F.when(key % 3 == 0, e).when(key % 3 == 1, ago(50)))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", "f.birth", "f.issue", "f.expiry")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'F' THEN 'granted' ELSE 'unknown' END AS meaning,
       CASE o_orderkey % 4 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Study abroad' WHEN 2 THEN o_orderstatus END AS purpose, CASE o_orderkey % 4 WHEN 0 THEN 'Hotel' WHEN 1 THEN 'Hotel' WHEN 2 THEN 'Hotel' END AS stay,
       CASE o_orderkey % 3 WHEN 0 THEN 'Noi Bai Int Airport (Ha Noi)' WHEN 1 THEN 'Da Nang Int Airport (Da Nang)' END AS gate
FROM orders""")
def q_named(spark, sf_dir):
    """Statuses, purposes, stays and gates in a form's words."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    said = F.when(key % 4 == 0, " Tourism").when(key % 4 == 1, "STUDY").when(key % 4 == 2, F.concat(status, F.lit(" "))).otherwise(F.when(key % 8 == 3, ""))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        wording.status_meaning(F.when(status == "O", "Still Processing").when(status == "F", " GRANTED, see mail ").otherwise(status)).alias("meaning"),
        wording.purpose_named(said).alias("purpose"),
        wording.stay_named(said).alias("stay"),
        wording.gate_from_ticket(F.when(key % 3 == 0, "HANOI NOI BAI"), F.when(key % 3 == 1, "Da Nang")).alias("gate"),
    )


@query("""SELECT source AS chat, count(*) AS noise FROM documents WHERE doc_id % 3 = 0 OR regexp_matches(text, 'forter\\.com', 'i') GROUP BY source""")
def q_noise(spark, sf_dir):
    """Lines of a site's own by source."""
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" https://www.Google-Analytics.com/x"))).otherwise(F.col("text"))
    return wording.noise_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("chat"), line.alias("line")))


@query("""
SELECT o_orderkey, 'visaNumber' AS field, 'nineDigits' AS why, NULL::INTEGER AS days FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 UNION ALL
SELECT o_orderkey, 'passportExpiryDate', 'tooCloseToVisa', (o_orderkey % 60)::INTEGER FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 60 < 30""")
def q_refusals(spark, sf_dir):
    """What a site will refuse of visas made of orders."""
    key, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    number = F.concat(F.lpad(key.cast("string"), 9, "0"), F.when(key % 5 == 0, "1").otherwise(""), F.when(key % 2 == 0, " /ev").otherwise(""))
    found = wording.refusals(number, F.when(key % 3 != 0, "Single E-Visa").otherwise("sticker"), d, F.when(key % 7 != 0, F.date_add(d, (key % 60).cast("int"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(found))


@query("""
SELECT c_custkey AS left_id, s_suppkey AS right_id FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50 AND c_custkey % 2 = 0 AND s_suppkey % 3 <> 0""")
def q_same_address(spark, sf_dir):
    """Customers and suppliers of one flat."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = table(spark, sf_dir, "customer").select(c.alias("id"), F.lit(True).alias("house_matches"), (c % 50).alias("osm_id"), F.when(c % 2 == 1, "7").alias("flat"))
    right = table(spark, sf_dir, "supplier").select(s.alias("id"), (s % 3 != 0).alias("house_matches"), (s % 50).alias("osm_id"), F.lit("").alias("flat"))
    return wording.same_address(left, right)


@query("""
SELECT c_custkey AS entity, 1 AS idx, 'Ward of ' || n_name AS ward, '"Quận ' || n_name || '" is a former district; the form now lists it as Ward of ' || n_name || '.' AS note
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 AND n_nationkey <> 3""")
def q_ward(spark, sf_dir):
    """Wards of former districts that addresses name."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.concat(F.when(F.col("c_custkey") % 4 != 0, "Quận ").otherwise(""), "n_name")
    parts = c.select(F.col("c_custkey").alias("entity"), F.posexplode(F.array(F.col("c_name"), part, part)).alias("idx", "part"))
    wards = n.select(text.place_key(F.col("n_name")).alias("district"), F.concat(F.lit("Ward of "), "n_name").alias("ward"))
    return wording.ward_from_district(parts, wards, wards.join(n.where("n_nationkey <> 3"), F.col("ward").endswith(F.concat(F.lit(" "), "n_name"))).select("ward"))


@query("""SELECT avg(y) AS y FROM (SELECT min(l_quantity) AS y FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 GROUP BY l_orderkey)""")
def q_calibrated(spark, sf_dir):
    """The mean first hit of an order."""
    return wording.calibrated_row(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_quantity").alias("y")), 10.0, 30.0)


@query("""SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AND user_id <> 1""")
def q_mail_filter(spark, sf_dir):
    """Events as mails, by words, senders and age."""
    sender = F.concat(F.lit("<u"), F.col("user_id").cast("string"), F.lit("@mail.com>"))
    wanted = wording.mail_filter(F.col("event_type"), sender, F.col("ts"), F.lit("2024-02-01").cast("timestamp"), ["MAIL"], ["Click", "view", "error"], 20, ("error", "<u1@mail.com"))
    return table(spark, sf_dir, "events").where(wanted).select("event_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'document' WHEN doc_id % 2 = 0 THEN 'photo' ELSE 'text' END AS kind,
       CASE WHEN length(text) > 4000 THEN left(text, 4000) || '…' ELSE nullif(text, '') END AS text,
       CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 2 = 0 THEN 'large' END AS file_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN n_chars END AS bytes, lower(source) AS sent, 'a,b,c' AS buttons
FROM documents""")
def q_entries(spark, sf_dir):
    """Documents as messages that came in and went out."""
    k, n = F.col("doc_id"), F.col("n_chars")
    photos = F.when(k % 2 == 0, F.array(F.struct(F.lit("small").alias("id"), (n - 1).alias("bytes")), F.struct(F.lit("large").alias("id"), n.alias("bytes"))))
    document = F.when(k % 3 == 0, F.struct(F.col("lang").alias("id"), F.col("source").alias("name"), n.alias("bytes")))
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    entries = table(spark, sf_dir, "documents").select("doc_id", wording.incoming_entry(F.col("text"), F.lit(""), photos, document).alias("i"), wording.outgoing_entry(F.concat(F.lit("send"), "source"), F.lit(None).cast("string"), F.lit(""), rows).alias("o"))
    return entries.select("doc_id", "i.kind", "i.text", F.col("i.file.id").alias("file_id"), F.col("i.file.bytes").alias("bytes"), F.col("o.kind").alias("sent"), F.array_join("o.buttons", ",").alias("buttons"))


@query("""
WITH v AS (
  SELECT c_custkey AS entity, 'name' AS field, c_name AS value, 'given' AS mark FROM customer WHERE c_custkey % 2 = 0 UNION ALL
  SELECT c_custkey, 'name', c_name, 'assumed' FROM customer WHERE c_custkey % 2 = 1 UNION ALL
  SELECT c_custkey, 'segment', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'derived' ELSE 'assumed' END FROM customer WHERE c_custkey % 3 <> 0 UNION ALL
  SELECT c_custkey, 'segment', '', 'disputed' FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 10)
SELECT * FROM v""")
def q_provenance(spark, sf_dir):
    """Where each value of a customer comes from."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    segment = F.when(key % 3 != 0, F.col("c_mktsegment")).otherwise("")
    values = c.select(key.alias("entity"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), segment)).alias("field", "value"))
    supplied = c.where(key % 2 == 0).select(key.alias("entity"), F.lit("name").alias("field"))
    origins = spark.createDataFrame([("segment", "name"), ("segment", "nation")], "field string, origin string")
    return wording.provenance(values, supplied, origins, c.where("c_nationkey < 10").select(key.alias("entity"), F.lit("segment").alias("field")))


@query("""SELECT DISTINCT source AS page, lang AS field FROM documents WHERE lang NOT IN ('en', 'fr')""")
def q_unmapped(spark, sf_dir):
    """Languages of a source that a list lacks."""
    required = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("source").alias("page"), F.col("lang").alias("field"))
    return wording.unmapped_required(required, spark.createDataFrame([("en",), ("fr",), (None,)], "field string"))


# Pages and forms


@query(r"""
WITH c AS (SELECT c_custkey AS k, DATE '1950-01-01' + (c_custkey * 37 % 20000)::INT AS birth, DATE '2015-01-01' + (c_custkey * 11 % 3000)::INT AS issue, * FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT k AS doc, '71' || lpad(k::VARCHAR, 7, '0') AS number, CASE WHEN k % 6 <> 0 THEN c_mktsegment END AS surname, CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN 'ANN-MARIE' WHEN 1 THEN 'BO' END END AS given,
       birth::VARCHAR AS birth, issue::VARCHAR AS issue, (issue + INTERVAL 10 YEAR)::DATE::VARCHAR AS expiry, CASE k % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex,
       CASE WHEN k % 4 = 0 THEN 'МОСКВА/USSR' WHEN k % 4 = 1 THEN 'ТВЕРЬ' END AS place, CASE WHEN k % 7 = 0 THEN 'Г/К РОССИИ, ДЕЛИ' WHEN k % 7 < 5 THEN 'МВД ' || (1000 + k % 9000) END AS authority
FROM c""")
def q_pages(spark, sf_dir):
    """Pages printed of all customers, line by line, read back by their labels."""
    k, say = F.col("c_custkey"), F.lit
    birth, issue = F.expr("date_add(DATE'1950-01-01', CAST(c_custkey * 37 % 20000 AS INT))"), F.expr("date_add(DATE'2015-01-01', CAST(c_custkey * 11 % 3000 AS INT))")
    by_three = lambda *kinds: F.when(k % 3 == 0, kinds[0]).when(k % 3 == 1, kinds[1]).otherwise(kinds[2])
    day = lambda d: by_three(F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "ddMM-yyyy"), F.date_format(d, "dd/MM:yyyy"))
    lines = F.array(
        F.concat(by_three(say("71№"), say("71 N:"), say("71#")), F.lpad(k.cast("string"), 7, "0")), say("РОССИЙСКАЯ ФЕДЕРАЦИЯ"), F.when(k % 6 != 0, "Фамилия / Surname"), F.when(k % 2 == 0, "  "), F.upper("c_mktsegment"),
        F.when(k % 5 != 0, "Имя / Given names"), by_three(say("ANN-MARIE"), say("Bo"), say("DATE OF")), F.when(k % 4 < 2, "Место рождения / Place of birth"), F.when(k % 4 == 1, "12 345"),
        F.concat(day(birth), F.when(k % 4 == 0, " Г.МОСКВА/USSR").when(k % 4 == 1, " тверь").when(k % 4 == 2, " ТВЕРЬ").otherwise("")), by_three(say("М/M"), say("Ж / F"), say("M F")), say("Дата выдачи / Date of issue"),
        day(issue), day(F.add_months(issue, 120)), F.when(k % 7 < 5, "Орган / Authority"), F.when(k % 7 == 0, "Е/К РОССИИ, ДЕЛИ").otherwise(F.concat(say("МВД "), (1000 + k % 9000).cast("string"))),
    )
    printed = table(spark, sf_dir, "customer").select(k.alias("doc"), F.posexplode(lines).alias("line_no", "line"))
    read = pages.read_pages(printed, spark.createDataFrame([("Москва",), ("Тверь",)], "word string"))
    return read.withColumns({c: F.col(c).cast("string") for c in ("birth", "issue", "expiry")})


@query(r"""
SELECT p_partkey AS doc, u.key, CASE u.key WHEN 'name' THEN p_name WHEN 'brand' THEN p_brand WHEN 'type' THEN p_type || ', ' || p_name || ' ' || p_brand WHEN 'size' THEN p_size::VARCHAR END AS value
FROM part, (SELECT unnest(['name', 'brand', 'type', 'size']) AS key) u WHERE NOT (u.key = 'size' AND p_partkey % 3 = 0)""")
def q_forms(spark, sf_dir):
    """Forms of two columns printed of all parts, with a value that goes on below its label, read back."""
    k, pad = F.col("p_partkey"), F.lpad(F.lit(""), 30, " ")
    lines = F.array(
        F.lit("A FORM"), F.concat(F.rpad(F.concat(F.lit("1.1. Name: "), F.col("p_name")), 30, " "), F.lit("1.2. Brand of it: "), F.col("p_brand")),
        F.concat(F.lit("1.3. Use: none"), F.lit(" " * 16), F.lit("1.4. Type (of all): "), F.col("p_type"), F.lit(" ,"), F.col("p_name"), F.lit(" " * 12)), F.concat(pad, F.col("p_brand")),
        F.when(k % 2 == 0, "  ").otherwise("Note: what follows isn't of the type"), F.concat(F.lit("1.5. Size: "), F.when(k % 3 != 0, F.col("p_size").cast("string")).otherwise(" "), F.lit(" 1.6. Left out: x")), F.lit("Size: none"),
    )
    printed = table(spark, sf_dir, "part").select(k.alias("doc"), F.posexplode(lines).alias("line_no", "line"))
    return forms.column_values(printed, [("name", "1.1. Name", True), ("brand", "1.2. Brand", False), ("type", "1.4. Type", True), ("size", "1.5. Size", True)], ["Note:"])


@query(r"""
WITH c AS (SELECT conv_id AS doc, turn, (conv_id * 7 + turn * 5) % 9 AS k, lpad((conv_id * 100 + turn)::VARCHAR, 9, '0') AS n FROM conversations),
b AS (SELECT *, coalesce(last_value(CASE WHEN k = 0 THEN false WHEN k IN (1, 2) THEN true END IGNORE NULLS) OVER w, false) AS inside FROM c WINDOW w AS (PARTITION BY doc ORDER BY turn)),
p AS (SELECT *, k IN (4, 7) OR (k = 3 AND inside) AS known FROM b WHERE k IN (3, 4, 7)),
o AS (SELECT *, known OR coalesce(bool_or(NOT known) OVER (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS theirs FROM p),
v AS (SELECT doc, turn, CASE WHEN theirs THEN 'emergency_phone' ELSE 'phone' END AS f, '+7' || n AS v FROM o UNION ALL SELECT doc, turn, 'emergency_relationship', CASE k WHEN 4 THEN 'Grandfather' WHEN 7 THEN 'Brother' END FROM o WHERE theirs
  UNION ALL SELECT doc, turn, 'emergency_relationship', 'Sister' FROM b WHERE k = 2 UNION ALL SELECT doc, turn, 'emergency_name', CASE k WHEN 2 THEN 'Ann Poe' ELSE 'Bo O''Hara-Li' END FROM b WHERE k = 2 OR (k = 6 AND inside)
  UNION ALL SELECT doc, turn, 'email', 'a' || turn || '@b.example' FROM b WHERE k = 8)
SELECT doc, arg_min(v, turn) FILTER (f = 'phone') AS phone, arg_min(v, turn) FILTER (f = 'emergency_phone') AS emergency_phone, arg_min(v, turn) FILTER (f = 'emergency_relationship') AS emergency_relationship,
       arg_min(v, turn) FILTER (f = 'emergency_name') AS emergency_name, arg_min(v, turn) FILTER (f = 'email') AS email FROM v WHERE v IS NOT NULL GROUP BY doc""")
def q_contacts(spark, sf_dir):
    """Turns of all conversations turned into lines with headings, phones and names: whose each is."""
    n, k = F.lpad((F.col("conv_id") * 100 + F.col("turn")).cast("string"), 9, "0"), (F.col("conv_id") * 7 + F.col("turn") * 5) % 9
    kinds = [" ", "Контактное лицо: ", "Сестра: Ann Poe", F.concat(F.lit("+7 "), n), F.concat(F.lit("деда тел. +7"), n), F.concat_ws(": ", F.lit("text"), F.col("role")), "Bo O'Hara-Li", F.concat(F.lit("+7-"), n, F.lit(" (brother)")), F.concat(F.lit("a"), F.col("turn").cast("string"), F.lit("@b.example"))]
    line = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(kinds)])
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line_no"), line.alias("line"))
    return contacts.contact_records(lines).select("doc", "phone", "emergency_phone", "emergency_relationship", "emergency_name", "email")


@query(r"""
WITH v AS (SELECT regexp_extract(text, '^\S+ \S+ \S+') AS value FROM benchmark UNION SELECT event_type FROM events UNION SELECT lang FROM documents)
SELECT doc_id, value FROM documents JOIN v ON contains(lower(text), lower(value)) WHERE trim(value) <> ''""")
def q_values_in_texts(spark, sf_dir):
    """Beginnings of benchmark passages, kinds of events and languages, as values that all documents are searched for."""
    t = lambda name: table(spark, sf_dir, name)
    values = t("benchmark").select(F.regexp_extract("text", r"^\S+ \S+ \S+", 0).alias("value")).unionByName(t("events").select(F.col("event_type").alias("value"))).unionByName(t("documents").select(F.col("lang").alias("value")))
    return patterns.values_in_texts(t("documents"), values, "doc_id")


@query(r"""
WITH r AS (SELECT DISTINCT split_part(p_name, ' ', 1 + p_partkey::INT % 2) AS "by" FROM part UNION SELECT DISTINCT substr(p_type, 1, 3) FROM part)
SELECT DISTINCT value, "by" FROM (SELECT p_name AS value FROM part UNION SELECT p_type || ' ' || p_brand FROM part) JOIN r ON contains(lower(value), lower("by")) WHERE trim("by") <> ''""")
def q_kept_at_risk(spark, sf_dir):
    """Names and types of all parts that redacting some of their words would change."""
    p = table(spark, sf_dir, "part")
    kept = p.select(F.col("p_name").alias("value")).unionByName(p.select(F.concat_ws(" ", "p_type", "p_brand").alias("value")))
    words = p.select(F.expr("split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INT))").alias("value")).unionByName(p.select(F.substring("p_type", 1, 3).alias("value")))
    return patterns.kept_at_risk(kept, words)


@query(r"""
WITH c AS (SELECT c_custkey AS doc, c_mktsegment AS seg, n_nationkey AS n, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT doc, CASE WHEN doc % 5 <> 0 THEN doc || '/7 ' || seg || ' St' || CASE WHEN doc % 3 <> 0 THEN ', ' || upper(seg[1:1]) || lower(seg[2:]) || ' Hai Ward' ELSE '' END || CASE WHEN doc % 4 <> 0 THEN ', Nation ' || n ELSE '' END END AS address,
       CASE WHEN doc % 3 <> 0 THEN seg || ' HAI' END AS ward, CASE WHEN doc % 4 <> 0 THEN 'NATION ' || n END AS town, CASE WHEN doc % 4 <> 0 THEN r_name END AS province FROM c""")
def q_addresses(spark, sf_dir):
    """One-line addresses of all customers, with wards and towns that all nations list, split into their parts."""
    t, k = (lambda name: table(spark, sf_dir, name)), F.col("c_custkey")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower(F.replace("n_name", F.lit("_"), F.lit("  "))).alias("name"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("town"), F.col("r_name").alias("province"))
    street, ward = F.concat(k.cast("string"), F.lit("/7 "), F.col("c_mktsegment"), F.lit(" St")), F.concat(F.when(k % 2 == 0, "Phường ").otherwise(""), F.lower("c_mktsegment"), F.lit("  hai"), F.when(k % 2 == 1, " ward").otherwise(""))
    town = F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string"))
    line = F.concat_ws(" ,", F.when(k % 5 != 0, street), F.when(k % 3 != 0, ward), F.when(k % 4 != 0, town), F.when(k % 2 == 0, "VIET NAM"))
    return addresses.split_addresses(t("customer").select(k.alias("doc"), line.alias("line")), places)


@query(r"""
WITH RECURSIVE r AS (SELECT user_id AS page, event_type AS value, ts, event_id, floor(value / 4)::INT * 2.0::DOUBLE AS x, floor(epoch(ts) / 86400) % 2 * 10.0::DOUBLE AS y FROM events),
b AS (SELECT page, value, x, y, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY page, value, y ORDER BY first) AS k FROM b),
f AS (SELECT page, value, y, 0::BIGINT AS k, []::STRUCT(x DOUBLE, votes BIGINT)[] AS e FROM o GROUP BY ALL
  UNION ALL SELECT f.page, f.value, f.y, o.k, CASE WHEN list_position(list_transform(e, lambda z: abs(z.x - o.x) < 3), true) > 0
    THEN list_transform(e, lambda z, i: {'x': z.x, 'votes': z.votes + CASE WHEN i = list_position(list_transform(e, lambda q: abs(q.x - o.x) < 3), true) THEN o.n ELSE 0 END}) ELSE list_append(e, {'x': o.x, 'votes': o.n}) END
  FROM f JOIN o ON f.page = o.page AND f.value = o.value AND f.y = o.y AND o.k = f.k + 1),
d AS (SELECT page, value, y, unnest(e) AS u FROM (SELECT page, value, y, arg_max(e, k) AS e FROM f GROUP BY ALL))
SELECT page, value, u.x AS x, y, 1.5::DOUBLE AS h, u.votes AS votes FROM d""")
def q_pooled_votes(spark, sf_dir):
    """All events as readings of their type at a place that value and day give, pooled by user."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) % 2
    readings = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("value"), (F.floor(F.col("value") / 4) * 2.0).alias("x"), (day * 10.0).alias("y"), F.lit(1.5).alias("h"))
    return spatial.pooled_votes(readings)


@query(r"""
SELECT c_custkey AS id, 'Russian Federation, ' || (100000 + c_custkey)::VARCHAR || CASE c_custkey % 4 WHEN 0 THEN ', Moscow' WHEN 1 THEN ', Moscow Region, Dubna' WHEN 2 THEN ', Krasnodar Krai, Sochi' ELSE ', Odintsovskii District, Lesnoi' END
  || CASE c_custkey % 3 WHEN 0 THEN ', Mira street ' WHEN 1 THEN ', Leninskii avenue ' ELSE ', Tverskaia highway ' END || (1 + c_custkey % 90) || CASE WHEN c_custkey % 5 = 0 THEN 'a' ELSE '' END
  || CASE WHEN c_custkey % 2 = 0 THEN ', bld. ' || (c_custkey % 7 + 1) ELSE '' END || ', apt. ' || (c_custkey % 300 + 1) AS address FROM customer""")
def q_home_addresses(spark, sf_dir):
    """Addresses of all customers as Russians write them, in Latin letters."""
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    pick = lambda n, *xs: F.coalesce(*[F.when(k % n == i, x) for i, x in enumerate(xs)])
    line = F.concat_ws(
        ", ", pick(2, "Россия", "РФ"), s(100000 + k), pick(4, "г. Москва", "Московская область, г.Дубна", "край Краснодарский, Сочи", "Одинцовский р-н, пос. Лесной"), pick(3, "ул. Мира", "Ленинский пр-т", "ш. Тверская"),
        F.concat(pick(2, "д. ", "дом "), s(1 + k % 90), F.when(k % 5 == 0, "a").otherwise("")), F.when(k % 2 == 0, F.concat(pick(4, "корп. ", "", "к", ""), s(k % 7 + 1))), F.concat(pick(3, "кв. ", "кв.", "квартира "), s(k % 300 + 1)),
    )
    return dealt(spark, sf_dir, "customer", "c_custkey").select(k.alias("id"), home_address.latin_address(line).alias("address"))
