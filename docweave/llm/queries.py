"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import collocations, hnsw, jaccard_join, mixing, near_dedup, packing, quality_lm, quality_rules, repeats, tokens, url_filter, vector_codes, warc
from docweave.llm.common import materialize, table


#: The rules of op1: host and path to verdict.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every ``pages`` url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit over all ``documents``."""
    return tokens.limit_totals(materialize(tokens.length_histogram(table(spark, sf_dir, "documents")), "lengths"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(mixing.word_sizes(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 ids, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line labeller for all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    crf = quality_rules.fit_line_crf(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, crf)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all ``documents``."""
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back, a row per capture."""
    return warc.captures(table(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 100 bytes leave of each of all ``documents``."""
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of each of all ``documents``: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` to each whose id 20 divides."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each of all ``documents``: four-word shingles, similarity 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of all ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all ``embeddings`` that can be quantized."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_near_dedup": op11_near_dedup,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}


def _lloyd_sql(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """The assignments (a0, a1, ...) and codebooks (b0, b1, ...) of vectors ``p`` (vec_id, position, part, n), as common table expressions."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS (SELECT position, part, n, arg_min(entry, (far, entry)) AS entry, min(far) AS error FROM (
  SELECT u.position, u.part, u.n, b.entry, list_sum(list_transform(list_zip(u.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM u JOIN b{k} b USING (position)) GROUP BY ALL)""")
        if k < rounds:
            out.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.position, b.entry, coalesce(m.part, b.part) AS part FROM b{k} b LEFT JOIN (
  SELECT position, entry, list((s - ((s % w) + w) % w) // w ORDER BY i) AS part FROM (
    SELECT position, entry, i, sum(part[i] * n)::BIGINT AS s, sum(n)::BIGINT AS w FROM a{k}, (SELECT unnest(range(1, (SELECT any_value(len(part)) FROM u) + 1)) AS i) GROUP BY ALL)
  GROUP BY position, entry) m USING (position, entry))""")
    return ",\n".join(out)

SQL = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
e AS (SELECT d.*, ('0x' || substr(h, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 49999) // 50000) FROM d) AS shard FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT max((total - capped) / open_w) AS level FROM (SELECT (SELECT sum(source_size) FROM s)::BIGINT AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w) AS target, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s, l),
k AS (SELECT source, target / (2 * k - 1) AS quotient, k, total // 16 AS blocks FROM (SELECT *, unnest(range(1, (target / total * (total // 16))::BIGINT + 60)) AS k FROM t)),
r AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS place FROM k),
q AS (SELECT t.source, any_value(source_size) AS source_size, any_value(target) AS target, count(place) FILTER (place <= blocks) AS blocks FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source GROUP BY t.source),
p AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM e GROUP BY ALL),
j AS (SELECT p.*, q.source_size, q.target, q.blocks FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(1, (shard_size / source_size * blocks)::BIGINT + 60)) AS k FROM j)),
u AS (SELECT source, shard, any_value(source_size) AS source_size, any_value(target) AS target, any_value(shard_size) AS shard_size, least(16 * count(*) FILTER (place <= blocks), 3 * any_value(shard_size)) AS words FROM m GROUP BY source, shard),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e)
SELECT doc_id, size, source_size, target, (words // shard_size * size + greatest(0, least(size, words % shard_size - start)))::BIGINT AS taken
FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source AND c.shard = u.shard""",
    "op11_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, node = min(c) AS kept FROM r LEFT JOIN z ON z.doc_id = node GROUP BY node""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30),
j AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT j.lang, j.phrase, j.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM j JOIN g x ON x.lang = j.lang AND x.phrase = head JOIN g y ON y.lang = j.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b LEFT JOIN i USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000""",
    "op13_vector_codes": f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT rid, vec_id, position, ints[position * len(ints) // 16 + 1:(position + 1) * len(ints) // 16] AS part FROM v, (SELECT unnest(range(0, 16)) AS position)),
u AS MATERIALIZED (SELECT position, part, count(*) AS n FROM p GROUP BY ALL),
b0 AS MATERIALIZED (SELECT position, k AS entry, part FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS k FROM v) USING (rid) WHERE k < 64),
{_lloyd_sql(2)},
c AS (SELECT p.rid, string_agg(printf('%02x', a.entry), '' ORDER BY p.position) AS code, sum(a.error)::BIGINT AS error FROM p JOIN a2 a ON p.position = a.position AND p.part = a.part GROUP BY p.rid),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS d FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT d FROM h) AS codebooks_sha256 FROM v JOIN c USING (rid)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT node AS doc_id, min(c) AS class_id, (SELECT count(*) FROM l WHERE a = node) AS n_links FROM r GROUP BY node""",
    "op10_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
x AS (SELECT doc_id, s AS a, s + 100 AS b FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
i AS (SELECT *, sum((m IS NULL OR a > m)::INT) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM o),
sp AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, k),
q AS (SELECT doc_id, a AS pos, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp),
e AS (SELECT * FROM q UNION ALL SELECT d.doc_id, 1000000000, coalesce(m.b, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM sp GROUP BY doc_id) m USING (doc_id)),
k AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY pos) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS n FROM sp GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
