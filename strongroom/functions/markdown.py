"""Lines of a document: numbers, fences, headings and comments as column expressions.

A document is one row, so its lines and fences are worked out inside the row and only then
exploded: nothing is shuffled to find out whether a line lies in a fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"
# A fence is three or more of one mark, indented by at most three.
_FENCE = r"^[\s\p{Z}]{0,3}(`{3,}|~{3,})(.*)$"
_BLOCKS = "array<struct<open:int,close:int>>"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last line that is empty is not one."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n\z", ""), "\n")


def fence_blocks(lines: Column) -> Column:
    """One ``(open, close)`` pair of line numbers per fence; ``close`` is NULL when it never closes.

    Only lines that look like a fence are folded over, which is what keeps long documents cheap.
    """
    candidates = F.filter(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("at"), F.rtrim(line).alias("line"))),
        lambda c: c["line"].rlike(_FENCE),
    )
    facts = F.transform(
        candidates,
        lambda c: F.struct(
            c["at"].alias("at"),
            F.regexp_extract(c["line"], _FENCE, 1).alias("mark"),
            F.regexp_extract(c["line"], _FENCE, 2).alias("info"),
        ),
    )
    zero = F.struct(
        F.lit(None).cast("int").alias("open"),
        F.lit("").alias("mark"),
        F.array().cast(_BLOCKS).alias("blocks"),
    )

    def step(state: Column, c: Column) -> Column:
        opens = state["open"].isNull() & ~(c["mark"].startswith("`") & c["info"].contains("`"))
        closes = (
            state["open"].isNotNull()
            & (F.substring(c["mark"], 1, 1) == F.substring(state["mark"], 1, 1))
            & (F.length(c["mark"]) >= F.length(state["mark"]))
            & (F.trim(c["info"]) == "")
        )
        block = F.array(F.struct(state["open"].alias("open"), c["at"].alias("close"))).cast(_BLOCKS)
        return F.struct(
            F.when(opens, c["at"]).when(closes, F.lit(None).cast("int")).otherwise(state["open"]).alias("open"),
            F.when(opens, c["mark"]).when(closes, F.lit("")).otherwise(state["mark"]).alias("mark"),
            F.when(closes, F.concat(state["blocks"], block)).otherwise(state["blocks"]).alias("blocks"),
        )

    def finish(state: Column) -> Column:
        tail = F.array(F.struct(state["open"].alias("open"), F.lit(None).cast("int").alias("close"))).cast(_BLOCKS)
        return F.when(state["open"].isNull(), state["blocks"]).otherwise(F.concat(state["blocks"], tail))

    return F.aggregate(facts, zero, step, finish)


def lines_with_fences(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per line: ``number``, ``line`` and ``state`` outside, opens, inside or closes."""
    split = documents.select(*keep, split_lines(F.col(text)).alias("__lines"))
    fenced = split.withColumn("__blocks", fence_blocks(F.col("__lines")))
    last = F.size("__lines")

    def piece(start: Column, end: Column, state: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(state).alias("state"))

    inside = F.flatten(
        F.transform(
            "__blocks",
            lambda b: F.array(
                piece(b["open"], b["open"], "opens"),
                piece(b["open"] + 1, F.coalesce(b["close"] - 1, last), "inside"),
                piece(b["close"], b["close"], "closes"),
            ),
        )
    )
    between = F.transform(
        "__blocks",
        lambda b, i: piece(F.when(i == 0, 1).otherwise(F.get("__blocks", i - 1)["close"] + 1), b["open"] - 1, "outside"),
    )
    ended = F.when(F.size("__blocks") == 0, 0).otherwise(F.get("__blocks", F.size("__blocks") - 1)["close"])
    pieces = F.filter(
        F.concat(between, inside, F.array(piece(ended + 1, last, "outside"))),
        lambda p: p["end"] >= p["start"],
    )
    exploded = fenced.select(*keep, "__lines", F.inline(pieces))
    return exploded.select(
        *keep,
        "state",
        "start",
        F.posexplode(F.slice("__lines", F.col("start"), F.col("end") - F.col("start") + 1)).alias("__i", "line"),
    ).select(*keep, (F.col("start") + F.col("__i")).alias("number"), "line", "state")


def heading(line: Column) -> Column:
    """Level and text of a heading line, or NULL: one to six marks, then a space or nothing."""
    pattern = r"^(#{1,6})(?: (.*))?$"
    return F.when(
        line.rlike(pattern),
        F.struct(
            F.length(F.regexp_extract(line, pattern, 1)).alias("level"),
            F.trim(F.regexp_extract(line, pattern, 2)).alias("text"),
        ),
    )


def without_comments(text: Column) -> Column:
    """The text with every HTML comment removed; an unclosed one removes to the end."""
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")
