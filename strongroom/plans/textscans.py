"""Text scans over whole documents and pages, with findings appended according to the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import textscan as K
from strongroom.plans.registry import query, table

# Tails by source: what the scans look for, and what they must leave alone.
TAILS = """CASE source
  WHEN 'src0' THEN ' It is Verified, and original.' WHEN 'src1' THEN ' non-verified unoriginal tamper-proof' WHEN 'src2' THEN ' SHA256: ready/mdat'
  WHEN 'src3' THEN ' a \u2014 b' WHEN 'src4' THEN ' a&ndash;b' WHEN 'src5' THEN ' a - b \ufe58'
  WHEN 'src6' THEN ' see /HOME/me and AKIA1' WHEN 'src7' THEN ' c:/users onedrive' WHEN 'src8' THEN ' akia GHP_ ghs_x' WHEN 'src9' THEN ' %UserProfile%'
  WHEN 'src10' THEN ' at 10.20.30.40. or 127.0.0.1, 1.2.3.4.5 256.1.1.1 192.0.2.7 008.8.8.8'
  WHEN 'src11' THEN ' fe80::1 00:1b:44:11:3a:b7 12:34:56 ::1 de::de 2001:DB8::5 a:b:c:d 1::2 ' ELSE '' END"""


def documents(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "source", "lang", f"text || {TAILS} AS text")


DOCS = f"d AS (SELECT doc_id, source, lang, text || {TAILS} AS text FROM documents)"
WORDS = ", ".join(f"('{word}')" for word in K.FORBIDDEN_WORDS)


@query(
    "k1_forbidden_words",
    rf"""WITH {DOCS}, w(word) AS (VALUES {WORDS})
        SELECT doc_id, word FROM d JOIN w ON regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}-])' || word || '($|[^\p{{L}}\p{{N}}-])')""",
)
def forbidden_words(spark, d):
    return K.forbidden_words(documents(spark, d), "text", ["doc_id"])


def sql_any(column: str, fragments) -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    return "(" + " OR ".join(f"contains({column}, {quote(f)})" for f in fragments) + ")"


@query(
    "k2_long_dashes",
    f"""WITH {DOCS} SELECT doc_id FROM d WHERE {sql_any("text", [chr(c) for c in K.DASHES] + list(K.DASH_ENTITIES))}""",
)
def long_dashes(spark, d):
    return documents(spark, d).where(K.long_dashes(F.col("text"))).select("doc_id")


@query(
    "k3_environment_traces",
    f"""WITH {DOCS} SELECT doc_id, 'environment_path' AS trace FROM d WHERE {sql_any("lower(text)", [f.lower() for f in K.MACHINE_FRAGMENTS])}
        UNION ALL SELECT doc_id, 'credential' FROM d WHERE {sql_any("text", K.CREDENTIAL_FRAGMENTS)}""",
)
def environment_traces(spark, d):
    return K.environment_traces(documents(spark, d), "text", ["doc_id"])


@query(
    "k4_ipv4",
    f"""WITH {DOCS}, r AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[0-9.]+')), '.') AS address FROM d),
        s AS (SELECT *, string_split(address, '.') AS p FROM r)
        SELECT doc_id, address, count(*) AS times FROM s
        WHERE len(p) = 4 AND len(list_filter(p, lambda o: length(o) BETWEEN 1 AND 3 AND coalesce(TRY_CAST(o AS INT), 999) <= 255)) = 4
          AND address NOT IN ('0.0.0.0', '255.255.255.255') AND NOT regexp_matches(address, '^(127\\.|192\\.0\\.2\\.|198\\.51\\.100\\.|203\\.0\\.113\\.)')
        GROUP BY ALL""",
)
def ipv4(spark, d):
    found = K.ipv4_addresses(documents(spark, d), "text", ["doc_id"])
    return found.groupBy("doc_id", "address").agg(F.count(F.lit(1)).alias("times"))


@query(
    "k5_colon_addresses",
    f"""WITH {DOCS}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-fA-F:]+')) AS address FROM d),
        s AS (SELECT *, string_split(trim(address, ':'), ':') AS g, length(address) - length(replace(address, ':', '')) AS colons FROM r),
        t AS (SELECT *, len(list_filter(g, lambda x: x <> '')) AS filled FROM s)
        SELECT doc_id, address, count(*) AS times FROM t
        WHERE len(list_filter(g, lambda x: length(x) > 4)) = 0 AND regexp_matches(address, '[0-9]') AND colons >= 3 AND filled >= 2
          AND (filled >= 4 OR contains(address, '::')) AND lower(address) <> '::1'
          AND NOT starts_with(lower(address), '2001:db8:') AND NOT starts_with(lower(address), '2001:0db8:') GROUP BY ALL""",
)
def colon_addresses(spark, d):
    found = K.colon_addresses(documents(spark, d), "text", ["doc_id"])
    return found.groupBy("doc_id", "address").agg(F.count(F.lit(1)).alias("times"))


NL = "chr(10)"
FENCED = f"""CASE lang WHEN 'en' THEN '| ' || text || {NL} || '<!-- ' || split_part(text, {NL}, 1) || ' -->'
  WHEN 'fr' THEN '```' || {NL} || text || {NL} || '```' || {NL} || text ELSE text || {NL} || repeat('x', 120) || ' y' || {NL} || repeat('x', 109) || ' y z' END"""


@query(
    "k6_wide_lines",
    rf"""WITH f AS (SELECT doc_id, lang, length(text) - length(replace(text, {NL}, '')) + 1 AS n, {FENCED} AS t FROM documents),
        l AS (SELECT doc_id, lang, n, unnest(string_split(regexp_replace(t, '\n$', ''), {NL})) AS line,
                generate_subscripts(string_split(regexp_replace(t, '\n$', ''), {NL}), 1) AS number FROM f)
        SELECT doc_id, number, length(rtrim(line)) AS width FROM l
        WHERE length(rtrim(line)) > 110 AND regexp_matches(rtrim(line), '^.{{1,109}}\s') AND NOT starts_with(trim(line), '|')
          AND NOT (starts_with(trim(line), '<!--') AND suffix(trim(line), '-->')) AND NOT (lang = 'fr' AND number <= n + 2)""",
)
def wide_lines(spark, d):
    texts = table(spark, d, "documents").selectExpr("doc_id", f"{FENCED} AS t")
    return K.wide_lines(texts, "t", ["doc_id"])


PAGE = f"""html || {NL} || '[a](..' || chr(47) || page_id || ' "title") ![b](<x y>)' || {NL} || '  [lab]: <./next> rest' || {NL} || '[^n]: no' || {NL}
  || '~~~' || {NL} || '[c](inside)' || {NL} || '~~~' || {NL} || '<img src=''i.png''><a href="mailto:a@b"> [own](' || regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) || '#top) [none](#x)' || {NL}
  || '# Top' || {NL} || '## The Same: word_1' || {NL} || '## the same - word_1' || {NL} || '### The Same: word_1' """


def pages(spark, d):
    return table(spark, d, "pages").selectExpr(
        "page_id",
        "regexp_extract(url, '^https?://([^/?#]+)', 1) AS site",
        "regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path",
        f"{PAGE} AS t",
    )


PAGES = rf"""p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path,
    html, length(html) - length(replace(html, {NL}, '')) + 1 AS n, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS own FROM pages),
hl AS (SELECT page_id, unnest(string_split(html, {NL})) AS line, generate_subscripts(string_split(html, {NL}), 1) AS number FROM p),
li AS (SELECT page_id, number, unnest(list_concat(regexp_extract_all(line, 'href="([^"]*)"', 1), regexp_extract_all(line, 'src="([^"]*)"', 1),
         regexp_extract_all(line, 'href=''([^'']*)''', 1), regexp_extract_all(line, 'src=''([^'']*)''', 1), regexp_extract_all(line, '\]\(([^)]*)\)', 1))) AS target FROM hl
       UNION ALL SELECT page_id, n + 1, '../' || page_id FROM p UNION ALL SELECT page_id, n + 1, 'x' FROM p
       UNION ALL SELECT page_id, n + 2, './next' FROM p UNION ALL SELECT page_id, n + 7, 'i.png' FROM p
       UNION ALL SELECT page_id, n + 7, 'mailto:a@b' FROM p UNION ALL SELECT page_id, n + 7, own || '#top' FROM p UNION ALL SELECT page_id, n + 7, '#x' FROM p)"""


@query("k7_links", f"WITH {PAGES} SELECT page_id, number, target FROM li")
def links(spark, d):
    return K.links(pages(spark, d), "t", ["page_id"])


@query(
    "k8_broken_links",
    rf"""WITH {PAGES}, k AS (SELECT DISTINCT site, rtrim(path, '/') AS path FROM p),
        r AS (SELECT DISTINCT p.site, p.path, li.number, target, string_split(rtrim(p.path, '/'), '/') AS up,
                len(string_split(p.path, '/')) AS deep, string_split(target, '#')[1] AS t, contains(target, '#') AS frag, string_split(target, '#')[2] AS fragment
              FROM li JOIN p ON p.page_id = li.page_id WHERE target <> '' AND NOT starts_with(target, '#') AND NOT contains(target, '://') AND NOT starts_with(target, 'mailto:')),
        dir AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM r),
        a AS (SELECT *, rtrim(CASE WHEN t = '' THEN path WHEN starts_with(t, '/') THEN t
                WHEN starts_with(t, '../') THEN regexp_replace(dir, '[^/]*/$', '') || substr(t, 4)
                WHEN starts_with(t, './') THEN dir || substr(t, 3) ELSE dir || t END, '/') AS aim FROM dir)
        SELECT DISTINCT a.site, a.path, number, target, CASE WHEN k.path IS NULL THEN 'does not exist' ELSE 'no such anchor' END AS reason
        FROM a LEFT JOIN k ON k.site = a.site AND k.path = a.aim
        WHERE k.path IS NULL OR (frag AND fragment NOT IN ('top', 'the-same-word_1', 'the-same---word_1', 'the-same-word_1-1'))""",
)
def broken_links(spark, d):
    p = pages(spark, d)
    bare = F.regexp_replace("path", "/+$", "")
    found = K.links(p, "t", ["site", "path"])
    offered = K.anchors(p.withColumn("path", bare), "t", ["site", "path"])
    return K.broken_links(found, p.select("site", bare.alias("path")), offered).distinct()


@query(
    "k9_anchors",
    f"""WITH {PAGES} SELECT page_id, n + 8 AS number, 'top' AS anchor FROM p UNION ALL SELECT page_id, n + 9, 'the-same-word_1' FROM p
        UNION ALL SELECT page_id, n + 10, 'the-same---word_1' FROM p UNION ALL SELECT page_id, n + 11, 'the-same-word_1-1' FROM p""",
)
def anchors(spark, d):
    return K.anchors(pages(spark, d), "t", ["page_id"])


@query(
    "k10_index_completeness",
    "SELECT doc_id || '.md' AS name, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def index_completeness(spark, d):
    records = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "source")
    index = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("target"))
    return K.unlisted(records, index)


@query(
    "k11_key_parity",
    """WITH c AS (SELECT DISTINCT lang AS language, source || '.' || n_chars // 500 AS key FROM documents),
       l AS (SELECT DISTINCT language FROM c)
       SELECT l.language, c.key, 'missing' AS problem FROM c JOIN l ON true WHERE c.language = 'en' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.language = l.language AND x.key = c.key)
       UNION ALL SELECT language, key, 'extra' FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.language = 'en' AND x.key = c.key)""",
)
def key_parity(spark, d):
    catalogues = table(spark, d, "documents").select(
        F.col("lang").alias("language"),
        F.concat_ws(".", "source", F.expr("n_chars DIV 500")).alias("key"),
    )
    return K.key_parity(catalogues, "en")
