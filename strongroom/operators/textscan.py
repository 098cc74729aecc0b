"""Corpus text scans: words, dashes, traces of an environment, addresses, wide lines, links and anchors.

Every scan reads whole texts and keeps its patterns in the expression, so a scan is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.functions.binding import let
from strongroom.functions.markdown import lines_with_fences

# Words that read as a verdict, or as jargon.
FORBIDDEN_WORDS = (
    "verified",
    "authentic",
    "authenticated",
    "genuine",
    "proven",
    "unedited",
    "untampered",
    "tamper-proof",
    "tamperproof",
    "original",
    "certified",
    "secure",
    "validated",
    "compliant",
    "trusted",
    "ready",
    "accessible",
    "legitimate",
    "forensic",
    "bmff",
    "isobmff",
    "avcc",
    "stco",
    "co64",
    "moov",
    "mdat",
    "udta",
    "sha256",
    "nal",
)
# Em dash, en dash, horizontal bar, two-em dash, small em dash, and their entities.
DASHES = (0x2014, 0x2013, 0x2015, 0x2E3A, 0xFE58)
DASH_ENTITIES = ("&mdash;", "&ndash;", "&#8212;", "&#8211;", "&#x2014;", "&#x2013;")
# Paths of a development machine, without regard to case.
MACHINE_FRAGMENTS = (
    "/home/",
    "/Users/",
    "/root/",
    ":\\Users",
    ":/Users",
    "/mnt/c/",
    "/mnt/d/",
    "/mnt/e/",
    "OneDrive",
    "\\\\wsl",
    "%USERPROFILE%",
)
# Openings of credentials and keys, case kept.
CREDENTIAL_FRAGMENTS = (
    "PRIVATE KEY",
    "PuTTY-User-Key",
    "github_pat_",
    "ghp_",
    "gho_",
    "ghs_",
    "xoxb-",
    "AKIA",
)
# Addresses that may be written down.
ALLOWED_PREFIXES = ("127.", "192.0.2.", "198.51.100.", "203.0.113.")
ALLOWED_ADDRESSES = ("0.0.0.0", "255.255.255.255")
DOCUMENTATION_PREFIXES = ("2001:db8:", "2001:0db8:")
LINE_LIMIT = 110


def any_of(text: Column, fragments) -> Column:
    """Whether any fragment occurs in the text."""
    found = F.contains(text, F.lit(fragments[0]))
    for fragment in fragments[1:]:
        found = found | F.contains(text, F.lit(fragment))
    return found


def forbidden_words(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Forbidden words per document, whole words in any case; a hyphen belongs to its word."""
    listed = "|".join(sorted(FORBIDDEN_WORDS, key=len, reverse=True))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}-])({listed})(?![\p{{L}}\p{{N}}-])"
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.lower))
    return documents.select(*keep, F.explode(words).alias("word"))


def long_dashes(text: Column) -> Column:
    """Whether a text carries a long dash, as a character or as an entity."""
    return any_of(text, tuple(chr(code) for code in DASHES) + DASH_ENTITIES)


def environment_traces(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per document and class of trace."""
    lowered = tuple(fragment.lower() for fragment in MACHINE_FRAGMENTS)
    found = F.array_compact(
        F.array(
            F.when(let(F.lower(text), lambda low: any_of(low, lowered)), "environment_path"),
            F.when(any_of(F.col(text), CREDENTIAL_FRAGMENTS), "credential"),
        )
    )
    return documents.select(*keep, F.explode(found).alias("trace"))


def ipv4_addresses(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Dotted quads in bounds that are not on the allow list, one row per occurrence."""
    runs = documents.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(r"[0-9.]+"), 0)).alias("place", "run"))
    octet = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
    address = F.regexp_replace("run", r"^\.+|\.+$", "")
    allowed = F.col("address").isin(*ALLOWED_ADDRESSES)
    for prefix in ALLOWED_PREFIXES:
        allowed = allowed | F.col("address").startswith(prefix)
    return (
        runs.withColumn("address", address)
        .where(F.col("address").rlike(rf"^{octet}(?:\.{octet}){{3}}$") & ~allowed)
        .select(*keep, "place", "address")
    )


def colon_addresses(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Colon-separated hexadecimal addresses: version six or hardware, one row per occurrence."""
    runs = documents.select(
        *keep, F.posexplode(F.regexp_extract_all(text, F.lit("[0-9a-fA-F:]+"), 0)).alias("place", "address")
    ).where("address LIKE '%:%:%:%' OR address LIKE '%::%'")
    groups = F.split(F.regexp_replace("address", "^:+|:+$", ""), ":")
    colons = F.length("address") - F.length(F.replace("address", F.lit(":"), F.lit("")))
    filled = F.size(F.filter("groups", lambda g: g != ""))
    lowered = F.lower("address")
    allowed = lowered == "::1"
    for prefix in DOCUMENTATION_PREFIXES:
        allowed = allowed | lowered.startswith(prefix)
    return (
        runs.withColumn("groups", groups)
        .where(F.forall("groups", lambda g: F.length(g) <= 4))
        .where(F.col("address").rlike("[0-9]") & (colons >= 3) & (filled >= 2))
        .where(((filled >= 4) | F.contains("address", F.lit("::"))) & ~allowed)
        .select(*keep, "place", "address")
    )


def wide_lines(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Lines wider than the limit that could have been wrapped; fences, table rows and comments are left alone."""
    trimmed = F.trim("line")
    prose = ~trimmed.startswith("|") & ~(trimmed.startswith("<!--") & trimmed.endswith("-->"))
    line = F.regexp_replace("line", r"[\s\p{Z}]+$", "")
    return (
        lines_with_fences(documents, text, keep)
        .where((F.col("state") == "outside") & (F.length("line") > LINE_LIMIT))
        .where(prose)
        .withColumn("line", line)
        .withColumn("width", F.length("line"))
        .where((F.col("width") > LINE_LIMIT) & F.col("line").rlike(rf"(?s)^.{{1,{LINE_LIMIT - 1}}}[\s\p{{Z}}]"))
        .select(*keep, "number", "width")
    )


_INLINE = r"\]\(([^)]*)\)"
_DEFINED = r"^\s*\[([^\]^](?:(?!\]:).)*)\]:\s*(\S+)"
_QUOTED = (r'href="([^"]*)"', r'src="([^"]*)"', r"href='([^']*)'", r"src='([^']*)'")


def links(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Link targets per line outside fences: inline, reference definitions, and quoted attributes."""
    bare = lambda t: F.regexp_replace(t, "^[<>]+|[<>]+$", "")
    inline = F.transform(
        F.regexp_extract_all("line", F.lit(_INLINE), 1), lambda t: bare(F.substring_index(F.trim(t), " ", 1))
    )
    defined = F.when(F.col("line").rlike(_DEFINED), F.array(bare(F.regexp_extract("line", _DEFINED, 2)))).otherwise(
        F.array().cast("array<string>")
    )
    quoted = [F.regexp_extract_all("line", F.lit(pattern), 1) for pattern in _QUOTED]
    return (
        lines_with_fences(documents, text, keep)
        .where("state <> 'inside'")
        .select(*keep, "number", F.explode(F.concat(inline, defined, *quoted)).alias("target"))
    )


def is_relative(target: Column) -> Column:
    """Whether a target points into the same collection."""
    return ~(
        (target == "")
        | target.startswith("#")
        | F.contains(target, F.lit("://"))
        | target.startswith("mailto:")
        | target.startswith("tel:")
    )


def resolve(document: Column, path: Column) -> Column:
    """The path a relative target means, ``.`` and ``..`` applied; NULL when it leaves the root."""
    directory = F.regexp_replace(document, r"[^/]*$", "")
    joined = F.when(path == "", document).when(path.startswith("/"), path).otherwise(F.concat(directory, path))
    zero = F.array(F.lit("")).cast("array<string>")
    steps = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        zero,
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.lit(None).cast("array<string>"))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(walked, "/")


def anchors(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Anchors a document offers: slugs of its headings, repeats numbered from one."""
    lines = lines_with_fences(documents, text, keep).where("state = 'outside'")
    title = F.trim(F.regexp_replace("line", "^#+", ""))
    slug = F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))
    headed = lines.where(F.col("line").startswith("#")).select(*keep, "number", slug.alias("slug"))
    # A document is one row, so its headings are a bounded group.
    nth = F.row_number().over(Window.partitionBy(*keep, "slug").orderBy("number")) - 1
    return headed.withColumn("nth", nth).select(
        *keep, "number", F.when(F.col("nth") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "nth")).alias("anchor")
    )


def broken_links(found: DataFrame, known: DataFrame, offered: DataFrame) -> DataFrame:
    """Relative links that leave the collection, reach no document, or name no anchor of it.

    ``found(site, path, number, target)``, ``known(site, path)``, ``offered(site, path, anchor)``.
    """
    relative = found.where(is_relative(F.col("target")))
    aimed = relative.withColumns(
        {
            "fragment": F.when(F.contains("target", F.lit("#")), F.regexp_extract("target", "#(.*)$", 1)),
            "aim": resolve(F.col("path"), F.substring_index("target", "#", 1)),
        }
    )
    keep = ["site", "path", "number", "target"]
    labelled = lambda df, reason: df.select(*keep, F.lit(reason).alias("reason"))
    outside = aimed.where("aim IS NULL")
    documents = known.select("site", F.col("path").alias("aim")).distinct()
    absent = aimed.where("aim IS NOT NULL").join(documents, ["site", "aim"], "left_anti")
    targets = offered.select("site", F.col("path").alias("aim"), F.col("anchor").alias("fragment")).distinct()
    anchored = aimed.where("fragment IS NOT NULL").join(documents, ["site", "aim"], "left_semi")
    adrift = anchored.join(targets, ["site", "aim", "fragment"], "left_anti")
    return (
        labelled(outside, "leaves the collection")
        .unionByName(labelled(absent, "does not exist"))
        .unionByName(labelled(adrift, "no such anchor"))
    )


def unlisted(records: DataFrame, index_links: DataFrame) -> DataFrame:
    """Records the index does not link."""
    return records.join(index_links.select(F.col("target").alias("name")).distinct(), "name", "left_anti")


def key_parity(catalogues: DataFrame, base: str) -> DataFrame:
    """Keys a language lacks and keys it has beyond the base language.

    ``catalogues(language, key)``. A key's languages are a set no larger than the languages there are.
    """
    languages = catalogues.select(F.collect_set("language").alias("all")).scalar()
    held = catalogues.groupBy("key").agg(F.collect_set("language").alias("held")).withColumn("all", languages)
    in_base = F.array_contains("held", base)
    differing = F.when(in_base, F.array_except("all", "held")).otherwise(F.col("held"))
    return held.select(
        F.explode(differing).alias("language"),
        "key",
        F.when(in_base, "missing").otherwise("extra").alias("problem"),
    )
