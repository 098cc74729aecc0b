"""Registers and roadmaps kept as Markdown: entries, fields, rules, mentions and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.functions.markdown import heading, lines_with_fences

# Field labels in their order, which of them an entry needs, and the verdicts.
FIELDS = ("Verdict", "Milestone", "Question", "Method", "Decides", "Result")
REQUIRED = FIELDS[:5]
VERDICTS = ("measured", "reasoned", "unavailable", "not started")
FINDINGS = VERDICTS[:2]

BULLET = r"^- \*\*(.*?):\*\*(.*)$"
ENTRY = r"^P\d"
CANONICAL = r"^P(?:0[1-9]|[1-9]\d{1,4})$"
MENTION = r"(?<![\p{L}\p{N}])(P\d{2,})(?![\p{L}\p{N}])"


def canonical(token: Column) -> Column:
    """The number of an identifier in its one accepted spelling, else NULL."""
    value = F.substring(token, 2, 9).try_cast("int")
    return F.when(token.rlike(CANONICAL) & (value <= 65535), value)


def sectioned(documents: DataFrame, text: str, key: str, opening: str) -> DataFrame:
    """Lines with the section they belong to: the last opening heading before them.

    A level-two heading that does not match ``opening`` closes the section. A document is one row, so
    the window over its lines is bounded by it.
    """
    lines = lines_with_fences(documents, text, [key]).withColumn("line", F.rtrim("line"))
    outside = F.col("state") == "outside"
    headed = lines.withColumn("h", F.when(outside, heading(F.col("line"))))
    second = F.col("h.level") == 2
    mark = F.when(
        second,
        F.when(F.col("h.text").rlike(opening), F.struct(F.col("number").alias("at"), F.col("h.text").alias("title"))).otherwise(
            F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("title"))
        ),
    )
    upto = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return headed.withColumn("section", F.last(mark, ignorenulls=True).over(upto)).select(
        key,
        "number",
        "line",
        "state",
        F.col("h.level").alias("level"),
        F.col("section.at").alias("section_line"),
        F.col("section.title").alias("section_title"),
    )


def entry_fields(lines: DataFrame, key: str) -> DataFrame:
    """Fields of register entries, one row per bullet, continuations merged.

    A wrapped line continues the bullet above it unless a blank line came between. A result keeps
    everything to the next heading, line breaks and fences included.
    """
    body = lines.where(F.col("section_line").isNotNull() & (F.col("number") > F.col("section_line")) & F.col("level").isNull())
    outside = F.col("state") == "outside"
    label = F.when(outside & F.col("line").rlike(BULLET), F.regexp_extract("line", BULLET, 1))
    entry = Window.partitionBy(key, "section_line").orderBy("number")
    upto = entry.rowsBetween(Window.unboundedPreceding, 0)
    marked = body.withColumn("label", label).withColumns(
        {
            "bullet": F.count("label").over(upto),
            "in_result": F.coalesce(F.last("label", ignorenulls=True).over(upto) == "Result", F.lit(False)),
        }
    )
    of_bullet = Window.partitionBy(key, "section_line", "bullet").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.max((F.trim("line") == "").cast("int")).over(of_bullet) == 1
    wrapped = ~blank & F.col("line").startswith("  ") & outside
    part = (
        F.when(F.col("label").isNotNull(), F.trim(F.regexp_extract("line", BULLET, 2)))
        .when(F.col("in_result") & outside, F.regexp_replace("line", "^  ", ""))
        .when(F.col("in_result"), F.col("line"))
        .when(wrapped, F.trim("line"))
    )
    kept = marked.withColumn("part", part).where("bullet > 0 AND part IS NOT NULL")
    return (
        kept.groupBy(key, "section_line", "section_title", "bullet")
        .agg(
            F.max("label").alias("label"),
            F.min("number").alias("number"),
            F.max("in_result").alias("in_result"),
            F.expr("listagg(part, '\n') WITHIN GROUP (ORDER BY number)").alias("verbatim"),
        )
        .select(
            key,
            "section_line",
            "section_title",
            "bullet",
            "label",
            "number",
            F.when(F.col("in_result"), F.trim(F.regexp_replace("verbatim", r"^\s+|\s+\z", "")))
            .otherwise(F.replace("verbatim", F.lit("\n"), F.lit(" ")))
            .alias("value"),
        )
    )


def field_problems(fields: DataFrame, key: str) -> DataFrame:
    """Unknown, repeated, misplaced, empty and missing fields of every entry."""
    places = F.create_map(*[F.lit(part) for i, name in enumerate(FIELDS) for part in (name, i)])
    place = F.when(F.col("label").isin(*FIELDS), places[F.col("label")])
    entry = Window.partitionBy(key, "section_line").orderBy("bullet")
    of_label = Window.partitionBy(key, "section_line", "label").orderBy("bullet")
    judged = fields.withColumns(
        {"place": place, "nth": F.row_number().over(of_label), "before": F.count("label").over(entry) - 1}
    )
    problem = (
        F.when(F.col("place").isNull(), "unknown_field")
        .when(F.col("nth") > 1, "repeated_field")
        .when(F.col("place") != F.col("before"), "field_out_of_order")
        .when(F.trim("value") == "", "empty_field")
    )
    found = judged.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "section_line", "label", "problem")
    have = fields.groupBy(key, "section_line").agg(F.collect_set(F.when(F.col("label").isin(*FIELDS), F.col("label"))).alias("have"))
    missing = have.select(
        key,
        "section_line",
        F.explode(F.array_except(F.array(*[F.lit(name) for name in REQUIRED]), "have")).alias("label"),
        F.lit("missing_field").alias("problem"),
    )
    return found.unionByName(missing)


def entries(fields: DataFrame, key: str) -> DataFrame:
    """One row per entry with its fields side by side; the first of a repeated field counts."""
    picked = [
        F.min_by(F.when(F.col("label") == name, F.col("value")), F.when(F.col("label") == name, F.col("bullet"))).alias(
            name.lower()
        )
        for name in FIELDS
    ]
    return fields.groupBy(key, "section_line", "section_title").agg(*picked)


def result_problems(register: DataFrame) -> DataFrame:
    """A finding needs a result; anything else must not have one."""
    finding, has = F.col("verdict").isin(*FINDINGS), F.col("result").isNotNull()
    return register.withColumn(
        "problem",
        F.when(~F.col("verdict").isin(*VERDICTS), "unknown_verdict")
        .when(finding & ~has, "finding_without_result")
        .when(~finding & has, "result_without_finding"),
    ).where("problem IS NOT NULL")


def identifier_problems(register: DataFrame, key: str) -> DataFrame:
    """Identifiers that are not canonical, and those not above the one before them."""
    token = F.substring_index("section_title", " ", 1)
    numbered = register.withColumn("token", token).withColumn("id", canonical(F.col("token")))
    before = Window.partitionBy(key).orderBy("section_line").rowsBetween(-1, -1)
    return (
        numbered.withColumn("previous", F.max("id").over(before))
        .withColumn(
            "problem",
            F.when(F.col("id").isNull(), "malformed_heading").when(F.col("id") <= F.col("previous"), "out_of_order"),
        )
        .where("problem IS NOT NULL")
        .select(key, "section_line", "token", "problem")
    )


def mentions(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Identifiers a text mentions as whole tokens, canonical spelling, each once per row key."""
    tokens = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), 1))).alias("token"))
    return tokens.withColumn("id", canonical(F.col("token"))).where("id IS NOT NULL").select(*keep, "token", "id").distinct()


def listing(register: DataFrame, verdict: str | None = None, milestone=None) -> DataFrame:
    """Entries of one verdict, of one milestone, or of both."""
    kept = register
    if verdict is not None:
        kept = kept.where(F.col("verdict") == verdict)
    if milestone is not None:
        kept = kept.where(F.col("milestone") == milestone)
    return kept


def lookup(register: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries with the asked identifiers."""
    return register.join(ids.select("id").distinct(), "id")


def tally(spark: SparkSession, register: DataFrame) -> DataFrame:
    """How many entries carry each verdict, in documented order, none left out."""
    words = spark.createDataFrame([(i, v) for i, v in enumerate(VERDICTS)], "rank int, verdict string")
    counted = register.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return words.join(counted, "verdict", "left").select("rank", "verdict", F.coalesce("n", F.lit(0)).alias("count"))


def reconcile(register: DataFrame, sections: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Every way a register and a roadmap disagree.

    ``register(id, milestone)``, ``sections(milestone)``, ``mentioned(milestone, id)``.
    """
    keep = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "milestone")
    unknown = register.join(sections, "milestone", "left_anti")
    silent = register.join(sections, "milestone", "left_semi").join(mentioned, ["id", "milestone"], "left_anti")
    stray = mentioned.join(register, "id", "left_anti")
    return (
        keep(unknown, "unknown_milestone")
        .unionByName(keep(silent, "not_mentioned_in_its_milestone"))
        .unionByName(keep(stray, "mentioned_but_not_registered"))
    )
