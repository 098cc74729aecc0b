"""Register queries: each document becomes a Markdown register whose entries depend on its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.functions.markdown import heading, lines_with_fences, without_comments
from strongroom.operators import register as R
from strongroom.plans.registry import query, table

# One expression for both engines: plain concatenation and CASE.
TOKEN = "CASE WHEN lang <> 'de' AND doc_id < 10 THEN 'P0' || doc_id ELSE 'P' || doc_id END"
VERDICT = "CASE lang WHEN 'en' THEN 'measured' WHEN 'fr' THEN 'reasoned' WHEN 'es' THEN 'unavailable' ELSE 'not started' END"
RESULT = "((lang IN ('en', 'fr')) <> (source = 'src5'))"
NL = "chr(10)"
MARKDOWN = f"""'# ' || source || {NL} || '<!-- P77 hidden' || {NL} || 'still --> P88 seen' || {NL}
  || '~~~ sh' || {NL} || '## P99 not an entry' || {NL} || '```' || {NL} || text || {NL} || '~~~~' || {NL}
  || '## ' || {TOKEN} || ' the ' || lang || ' entry' || {NL} || {NL}
  || '- **Verdict:** ' || {VERDICT} || {NL}
  || '- **Milestone:** M' || (n_chars % 7) || {NL}
  || CASE WHEN source = 'src8' THEN '- **Method:** count' || {NL} ELSE '' END
  || '- **Question:** how many' || {NL} || '  characters has ' || source || {NL}
  || CASE WHEN source <> 'src8' THEN '- **Method:** count' || {NL} ELSE '' END
  || CASE WHEN source = 'src9' THEN '- **Method:** again' || {NL} ELSE '' END
  || CASE WHEN source = 'src12' THEN '- **Owner:** nobody' || {NL} ELSE '' END
  || CASE WHEN source = 'src10' THEN '- **Decides:** ' || {NL} WHEN source <> 'src6' THEN '- **Decides:** ' || lang || {NL} ELSE '' END
  || CASE WHEN {RESULT} THEN '- **Result:** ' || n_chars || {NL} || '  in all' || {NL} || '```' || {NL} || '  wc' || {NL} || '```' || {NL} ELSE '' END
  || {NL} || '## P' || CASE WHEN source = 'src3' THEN 1 ELSE 60000 END || ' second' || {NL} || '- **Verdict:** measured' || {NL}
  || '## Notes' || {NL} || '- **Stray:** x' || {NL} || text"""


def markdown(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "lang", "source", "n_chars", "text", f"{MARKDOWN} AS md")


MD = f"md AS (SELECT *, {MARKDOWN} AS md FROM documents)"
LINES = f"""{MD},
ln AS (SELECT doc_id, lang, source, n_chars, unnest(string_split(regexp_replace(md, '\\n$', ''), {NL})) AS line,
         generate_subscripts(string_split(regexp_replace(md, '\\n$', ''), {NL}), 1) AS number FROM md),
cl AS (SELECT doc_id, min(number) AS closed FROM ln WHERE line = '~~~~' GROUP BY 1),
rs AS (SELECT doc_id, min(number) AS r FROM ln WHERE line LIKE '- **Result:**%' GROUP BY 1),
st AS (SELECT ln.*, closed, CASE WHEN number = 4 OR number = r + 2 THEN 'opens' WHEN number = closed OR number = r + 4 THEN 'closes'
         WHEN number BETWEEN 5 AND closed - 1 OR number = r + 3 THEN 'inside' ELSE 'outside' END AS state
       FROM ln JOIN cl ON cl.doc_id = ln.doc_id LEFT JOIN rs ON rs.doc_id = ln.doc_id)"""


@query("j1_fence_state", f"WITH {LINES} SELECT doc_id, number, line, state FROM st")
def fence_state(spark, d):
    return lines_with_fences(markdown(spark, d), "md", ["doc_id"])


@query(
    "j2_headings",
    f"""WITH {LINES} SELECT doc_id, number, length(regexp_extract(line, '^(#{{1,6}})( |$)', 1)) AS level,
          trim(regexp_replace(line, '^#+ ?', '')) AS text FROM st WHERE state = 'outside' AND regexp_matches(line, '^#{{1,6}}( |$)')""",
)
def headings(spark, d):
    lines = lines_with_fences(markdown(spark, d), "md", ["doc_id"]).where("state = 'outside'")
    return lines.withColumn("h", heading(F.col("line"))).where("h IS NOT NULL").select("doc_id", "number", "h.level", "h.text")


@query(
    "j3_comment_removal",
    f"""SELECT doc_id, '# ' || source || {NL} || ' P88 seen' || {NL} || text || CASE WHEN lang = 'es' THEN '' ELSE 'end' END AS text
        FROM documents""",
)
def comment_removal(spark, d):
    """Whole texts behind a comment of two lines; Spanish ones end in a comment that never closes."""
    texts = table(spark, d, "documents").selectExpr(
        "doc_id",
        f"""'# ' || source || {NL} || '<!-- P77 hidden' || {NL} || 'still --> P88 seen' || {NL} || text
            || CASE WHEN lang = 'es' THEN '<!-- ' || text ELSE 'end' END AS t""",
    )
    return texts.select("doc_id", without_comments(F.col("t")).alias("text"))


def register_lines(spark, d):
    return R.sectioned(markdown(spark, d), "md", "doc_id", R.ENTRY)


@query(
    "j4_sections",
    f"""WITH {LINES}, h AS (SELECT *, state = 'outside' AND starts_with(line, '## ') AS second FROM st),
        e AS (SELECT *, count(*) FILTER (second) OVER (PARTITION BY doc_id ORDER BY number) AS nth FROM h),
        s AS (SELECT doc_id, nth, number AS section_line, substr(line, 4) AS title FROM e WHERE second AND regexp_matches(line, '^## P[0-9]'))
        SELECT e.doc_id, e.number, s.section_line, s.title AS section_title FROM e LEFT JOIN s ON s.doc_id = e.doc_id AND s.nth = e.nth""",
)
def sections(spark, d):
    return register_lines(spark, d).select("doc_id", "number", "section_line", "section_title")


FIELD = f"""{MD},
fl AS (
  SELECT doc_id, 1 AS e, 1 AS o, 'Verdict' AS label, {VERDICT} AS value FROM md
  UNION ALL SELECT doc_id, 1, 2, 'Milestone', 'M' || (n_chars % 7) FROM md
  UNION ALL SELECT doc_id, 1, CASE source WHEN 'src8' THEN 4 ELSE 3 END, 'Question', 'how many characters has ' || source FROM md
  UNION ALL SELECT doc_id, 1, CASE source WHEN 'src8' THEN 3 ELSE 4 END, 'Method', 'count' FROM md
  UNION ALL SELECT doc_id, 1, 5, 'Method', 'again' FROM md WHERE source = 'src9'
  UNION ALL SELECT doc_id, 1, 5, 'Owner', 'nobody' FROM md WHERE source = 'src12'
  UNION ALL SELECT doc_id, 1, 6, 'Decides', CASE source WHEN 'src10' THEN '' ELSE lang END FROM md WHERE source <> 'src6'
  UNION ALL SELECT doc_id, 1, 7, 'Result', n_chars || {NL} || 'in all' || {NL} || '```' || {NL} || '  wc' || {NL} || '```' FROM md WHERE {RESULT}
  UNION ALL SELECT doc_id, 2, 1, 'Verdict', 'measured' FROM md),
nf AS (SELECT *, row_number() OVER (PARTITION BY doc_id, e ORDER BY o) AS bullet FROM fl)"""


def fields(spark, d):
    return R.entry_fields(register_lines(spark, d), "doc_id")


def which():
    """First or second entry of its document, as the oracle names them."""
    return F.when(F.col("section_title").endswith(" second"), 2).otherwise(1).alias("e")


@query("j5_field_bullets", f"WITH {FIELD} SELECT doc_id, e, bullet, label, value FROM nf")
def field_bullets(spark, d):
    return fields(spark, d).select("doc_id", which(), "bullet", "label", "value")


@query(
    "j6_field_rules",
    f"""WITH {FIELD}, k(label, place) AS (VALUES ('Verdict', 0), ('Milestone', 1), ('Question', 2), ('Method', 3), ('Decides', 4), ('Result', 5)),
        p AS (SELECT nf.*, place, row_number() OVER (PARTITION BY doc_id, e, nf.label ORDER BY bullet) AS nth FROM nf LEFT JOIN k ON k.label = nf.label),
        x AS (SELECT doc_id, e, label, CASE WHEN place IS NULL THEN 'unknown_field' WHEN nth > 1 THEN 'repeated_field'
                WHEN place <> bullet - 1 THEN 'field_out_of_order' WHEN trim(value) = '' THEN 'empty_field' END AS problem FROM p)
        SELECT * FROM x WHERE problem IS NOT NULL
        UNION ALL SELECT d.doc_id, d.e, k.label, 'missing_field' FROM (SELECT DISTINCT doc_id, e FROM fl) d JOIN k ON place < 5
        ANTI JOIN fl ON fl.doc_id = d.doc_id AND fl.e = d.e AND fl.label = k.label""",
)
def field_rules(spark, d):
    found = fields(spark, d)
    entry = found.select("doc_id", "section_line", which()).distinct()
    return R.field_problems(found, "doc_id").join(entry, ["doc_id", "section_line"]).select("doc_id", "e", "label", "problem")


@query(
    "j7_result_consistency",
    f"""SELECT doc_id, 1 AS e, {VERDICT} AS verdict,
          CASE WHEN {RESULT} THEN 'result_without_finding' ELSE 'finding_without_result' END AS problem FROM documents WHERE source = 'src5'
        UNION ALL SELECT doc_id, 2, 'measured', 'finding_without_result' FROM documents""",
)
def result_consistency(spark, d):
    register = R.entries(fields(spark, d), "doc_id")
    return R.result_problems(register).select("doc_id", which(), "verdict", "problem")


@query(
    "j8_identifier_order",
    f"""WITH t AS (SELECT *, {TOKEN} AS token, doc_id > 0 AND (doc_id >= 10 OR lang <> 'de') AND doc_id <= 65535 AS ok FROM documents)
        SELECT doc_id, token, 'malformed_heading' AS problem FROM t WHERE NOT ok
        UNION ALL SELECT doc_id, 'P1', 'malformed_heading' FROM t WHERE source = 'src3'
        UNION ALL SELECT doc_id, 'P60000', 'out_of_order' FROM t WHERE source <> 'src3' AND ok AND 60000 <= doc_id""",
)
def identifier_order(spark, d):
    register = R.entries(fields(spark, d), "doc_id")
    return R.identifier_problems(register, "doc_id").select("doc_id", "token", "problem")


@query(
    "j9_mentions",
    f"""SELECT doc_id, 'P' || (10 + n_chars) AS token, (10 + n_chars)::INT AS id FROM documents WHERE 10 + n_chars <= 65535
        UNION SELECT doc_id, 'P08', 8 FROM documents WHERE lang = 'en'""",
)
def mentions(spark, d):
    """Whole texts followed by tokens of which some are glued, short, zero or spelled otherwise."""
    texts = table(spark, d, "documents").selectExpr(
        "doc_id",
        """text || ' (P' || (10 + n_chars) || '), xP31 P32x P7 P00 P012 éP33 P34é P' || (10 + n_chars)
           || CASE WHEN lang = 'en' THEN '-P08.' ELSE '' END AS t""",
    )
    return R.mentions(texts, "t", ["doc_id"])


def order_register(spark, d):
    """Orders as registered probes, customers as milestones."""
    verdict = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "measured")
        .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "reasoned")
        .otherwise("not started")
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        verdict.alias("verdict"),
        F.col("o_custkey").alias("milestone"),
        F.col("o_orderstatus").alias("status"),
        "o_orderpriority",
    )


ORDERS = """r AS (SELECT o_orderkey AS id, o_custkey AS milestone, o_orderstatus AS status, o_orderpriority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'measured' WHEN '2-HIGH' THEN 'reasoned' WHEN '3-MEDIUM' THEN 'reasoned' ELSE 'not started' END AS verdict FROM orders)"""


@query("j10_listing", f"WITH {ORDERS} SELECT id, milestone FROM r WHERE verdict = 'reasoned' AND status = 'F'")
def listing(spark, d):
    register = order_register(spark, d).drop("milestone").withColumnRenamed("status", "milestone")
    listed = R.listing(register, verdict="reasoned", milestone="F").select("id")
    return order_register(spark, d).join(listed, "id", "left_semi").select("id", "milestone")


@query(
    "j11_point_lookup",
    f"WITH {ORDERS} SELECT id, verdict, milestone FROM r WHERE id IN (SELECT doc_id FROM labels)",
)
def point_lookup(spark, d):
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return R.lookup(order_register(spark, d), asked).select("id", "verdict", "milestone")


@query(
    "j12_tally",
    f"""WITH {ORDERS}, v(rank, verdict) AS (VALUES (0, 'measured'), (1, 'reasoned'), (2, 'unavailable'), (3, 'not started'))
        SELECT rank, v.verdict, count(r.id) AS count FROM v LEFT JOIN r ON r.verdict = v.verdict GROUP BY ALL""",
)
def tally(spark, d):
    return R.tally(spark, order_register(spark, d))


@query(
    "j13_reconcile",
    f"""WITH {ORDERS}, s AS (SELECT c_custkey AS milestone FROM customer WHERE c_mktsegment <> 'MACHINERY'),
        m AS (SELECT milestone, id FROM r WHERE verdict <> 'measured' UNION SELECT l_suppkey, l_orderkey + l_partkey FROM lineitem WHERE l_returnflag = 'R')
        SELECT 'unknown_milestone' AS kind, id, milestone FROM r ANTI JOIN s USING (milestone)
        UNION ALL SELECT 'not_mentioned_in_its_milestone', id, milestone FROM r SEMI JOIN s USING (milestone) ANTI JOIN m USING (milestone, id)
        UNION ALL SELECT 'mentioned_but_not_registered', id, milestone FROM m ANTI JOIN r USING (id)""",
)
def reconcile(spark, d):
    register = order_register(spark, d)
    known = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("milestone"))
    named = register.where("verdict <> 'measured'").select("milestone", "id")
    strays = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("milestone"), (F.col("l_orderkey") + F.col("l_partkey")).alias("id")
    )
    return R.reconcile(register.select("id", "milestone"), known, named.unionByName(strays).distinct())
