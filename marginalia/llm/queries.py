"""One registered query for each corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    edit_fingerprint,
    html_text,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    pseudonyms,
    ranked_search,
    topk,
    toxicity,
    url_filter,
)
from marginalia.llm.common import table
from marginalia.scratch import written


#: The registered query's key; real runs pass their own secret.
PSEUDONYM_KEY = b"registered query"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are counted once; the texts go no further
    return mixing.mix(written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list lines for the hosts of ``pages`` and the domains right above them: four monthly states each.

    No list comes with the tables, so its lines are hashed from the names: of the hosts, and of each month's
    state (on the list, off it, or unchanged).
    """
    name = url_filter.host(F.col("url")).alias("domain")
    hosts = pages.select(name).where("domain <> ''").distinct()
    above = F.regexp_replace("domain", r"^[^.]+\.", "")
    names = hosts.union(hosts.where(F.size(F.split("domain", r"\.")) > 3).select(above)).distinct()
    months = names.select("domain", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("month"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", "domain", "month")), 1, 4), 16, 10).cast("int")
    category = F.get(F.array(*map(F.lit, ("adult", "gambling", "spam", "malware"))), F.pmod(F.length("domain"), F.lit(4)))
    return months.where(drawn % 3 < 2).select(
        "domain",
        category.alias("category"),
        F.when(drawn % 3 == 0, "add").otherwise("remove").alias("action"),
        F.make_timestamp(F.lit(2024), F.col("month"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"),
    )


def op4_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # captures have no time either: an hour of the first 150 days of 2024, hashed from the URL
    hour = F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("int") % 3600
    captures = pages.withColumn("fetched_at", F.timestamp_add("HOUR", hour, F.lit("2024-01-01 00:00:00").cast("timestamp")))
    judged = url_filter.judge_captures(captures, list_entries(pages))
    return judged.select(
        "page_id", "url", "host", F.array_join("categories", ",").alias("categories"), F.coalesce("matched_domain", F.lit("")).alias("matched_domain"), "blocked"
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, key=PSEUDONYM_KEY).withColumn("pii_kinds", F.array_join("pii_kinds", ","))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.find_toxic(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_topk_search,
        op3_line_dedup,
        op4_temporal_url_filter,
        op5_html_text,
        op6_minhash_dedup,
        op7_edit_fingerprint,
        op8_pseudonyms,
        op9_language_id,
        op10_packing,
        op11_prefix_trie,
        op12_ranked_search,
        op13_toxicity,
    )
}

#: The same rows in SQL for tables whose ids are unique; what it compares pair by pair suits the small tables only.
ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op3_line_dedup": """
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
 each AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM cut),
 pairs AS (SELECT doc_id, k, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS pair FROM each),
 ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY pair ORDER BY doc_id, k) AS r FROM pairs WHERE pair IS NOT NULL),
 repeated AS (SELECT DISTINCT doc_id, unnest([k, k + 1]) AS k FROM ranked WHERE r > 1),
 runs AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM repeated),
 gone AS (SELECT doc_id, k FROM runs JOIN each USING (doc_id, k) QUALIFY sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) OVER (PARTITION BY doc_id, run) >= 10),
 kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT c.doc_id, CASE WHEN c.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(len(l), 0) AS n_lines, coalesce(len(l), 0) - coalesce(k.n, 0) AS n_lines_removed
FROM cut c LEFT JOIN kept k USING (doc_id)""",
    "op4_temporal_url_filter": """
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(('0x' || substr(md5(url), 1, 6))::INTEGER % 3600) AS fetched,
  regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', ''), '^www\\.', '') AS host FROM pages),
 hosts AS (SELECT DISTINCT host AS domain FROM p WHERE host <> ''),
 names AS (SELECT domain FROM hosts UNION SELECT regexp_replace(domain, '^[^.]+\\.', '') FROM hosts WHERE len(string_split(domain, '.')) > 3),
 months AS (SELECT domain, month, ('0x' || substr(md5(concat_ws('/', domain, month)), 1, 4))::INTEGER % 3 AS drawn FROM names, range(1, 5) AS r(month)),
 entries AS (SELECT domain, ['adult', 'gambling', 'spam', 'malware'][length(domain) % 4 + 1] AS category, drawn = 0 AS listed, make_timestamp(2024, month, 1, 0, 0, 0) AS dated FROM months WHERE drawn < 2),
 last AS (SELECT page_id, domain, category, max_by(listed, dated) AS listed FROM p JOIN entries ON (host = domain OR ends_with(host, '.' || domain)) AND dated <= fetched GROUP BY ALL),
 found AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, max_by(domain, (length(domain), domain)) AS matched_domain FROM last WHERE listed GROUP BY 1)
SELECT page_id, url, host, coalesce(categories, '') AS categories, coalesce(matched_domain, '') AS matched_domain, categories IS NOT NULL AS blocked FROM p LEFT JOIN found USING (page_id)""",
    "op6_minhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT DISTINCT a AS node, a AS top FROM edges UNION SELECT edges.b, reach.top FROM reach JOIN edges ON edges.a = reach.node WHERE edges.b > reach.top),
 tops AS (SELECT node, min(top) AS top FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, d.doc_id) AS component_id, coalesce(top, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN tops ON node = d.doc_id""",
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
 sizes AS (SELECT conv_id, max(k) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, [ord(d)::BIGINT FOR d IN string_split(conv_id::VARCHAR, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM t GROUP BY 1),
 turns AS (SELECT s.conv_id, k AS depth, r, x FROM sizes s JOIN t ON t.conv_id = base AND k <= h
  UNION ALL SELECT s.conv_id, k - s.h + least(s.h, coalesce(b.n, 0)), r, x FROM sizes s JOIN t USING (conv_id) LEFT JOIN sizes b ON b.conv_id = s.base WHERE k > s.h),
 prefixes AS (SELECT conv_id, depth, octet_length(encode(x)) AS bytes, list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM turns UNION ALL SELECT conv_id, 0, 0, [] FROM sizes),
 members AS (SELECT *, min(conv_id) OVER (PARTITION BY prefix) AS node, count(*) OVER (PARTITION BY prefix) AS n, max(depth) OVER (PARTITION BY conv_id) AS length FROM prefixes),
 nodes AS (SELECT node AS conv_id, depth, any_value(n) AS n, any_value(bytes) AS bytes, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends, max(length) = depth AS leaf FROM members GROUP BY 1, 2),
 parents AS (SELECT c.conv_id, c.depth, m.node AS parent FROM nodes c JOIN members m ON m.conv_id = c.conv_id AND m.depth = c.depth - 1),
 children AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY 1, 2),
 sums AS (SELECT m.node AS conv_id, m.depth, sum((u.n - 1) * u.bytes) AS saved, count_if(u.leaf) AS leaves FROM nodes u JOIN members m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM nodes LEFT JOIN parents USING (conv_id, depth) LEFT JOIN children USING (conv_id, depth) JOIN sums USING (conv_id, depth)""",
    "op12_ranked_search": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
 totals AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS words FROM d WHERE len(t) > 0),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
 weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY 1),
 wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
 sized AS (SELECT doc_id, 50 + (50 * len(t) * docs) // words AS m FROM d, totals WHERE len(t) > 0),
 scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN sized USING (doc_id) GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
