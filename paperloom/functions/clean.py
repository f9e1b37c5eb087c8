"""Cleaning rules as Column expressions (CLN-*) and row predicates (FLT-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import fixed
from paperloom.functions.text import strip

# Field lengths of the relational model (CLN-03).
LENGTHS = {
    "title": 1000, "author": 256, "concept": 256, "publisher": 256,
    "institution": 512, "venue": 512, "type": 64, "country": 8,
    "ror": 128, "issn_l": 32, "default": 2000,
}


def normalize_id(c: Column) -> Column:
    """CLN-01: last path segment of an id or URL; null becomes ''."""
    tail = F.substring_index(F.rtrim(strip(c), F.lit("/")), "/", -1)
    return F.coalesce(tail, F.lit(""))


def entity_id(c: Column, strip_slash: bool = True) -> Column:
    """CLN-02: like normalize_id, with NULL for nothing."""
    if strip_slash:
        c = F.rtrim(c, F.lit("/"))
    return F.nullif(strip(F.substring_index(c, "/", -1)), F.lit(""))


def clean_string(c: Column, n: int = LENGTHS["default"]) -> Column:
    """CLN-03: trim, blank to NULL, cut to n characters."""
    return F.substring(F.nullif(strip(c), F.lit("")), 1, n)


def clean_orcid(c: Column, form: str = "url") -> Column:
    """CLN-04: the 19-character id found in the text, as URL or bare."""
    bare = F.nullif(F.regexp_extract(c, fixed.ORCID_PATTERN, 1), F.lit(""))
    return F.concat(F.lit(fixed.ORCID_PREFIX), bare) if form == "url" else bare


def clean_doi(c: Column) -> Column:
    """CLN-05: DOI without its URL or scheme prefix."""
    return F.nullif(F.regexp_replace(strip(c), fixed.DOI_PREFIX_PATTERN, ""), F.lit(""))


def parse_partial_date(c: Column) -> Column:
    """CLN-06: full date, year-month, or year; anything else is NULL."""
    c = strip(c)
    formats = {r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d", r"^\d{4}-\d{1,2}$": "yyyy-M", r"^\d{4}$": "yyyy"}
    return F.coalesce(
        *[
            F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt))).cast("date")
            for shape, fmt in formats.items()
        ]
    )


def clean_issn(c: Column) -> Column:
    """CLN-07: eight upper alphanumerics get the dash, else the first 20 characters."""
    whole = F.upper(strip(c))
    s = F.regexp_replace(whole, r"[^\p{L}\p{N}]", "")
    dashed = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 4))
    return F.nullif(F.when(F.length(s) == 8, dashed).otherwise(F.substring(whole, 1, 20)), F.lit(""))


def venue_issns(issn_l: Column, issn: Column) -> Column:
    """CLN-07: linking, print and online ISSN of a venue."""
    return F.struct(
        F.coalesce(clean_issn(issn_l), clean_issn(F.get(issn, F.lit(0)))).alias("issn"),
        clean_issn(F.get(issn, F.lit(0))).alias("issn_print"),
        clean_issn(F.get(issn, F.lit(1))).alias("issn_online"),
    )


def country2(c: Column) -> Column:
    """CLN-08"""
    return F.substring(F.upper(c), 1, 2)


def abstract_text(index: Column, keep_repeats: bool = False) -> Column:
    """CLN-09: words of an inverted abstract in position order.

    Two words on one position: the last map entry wins, or both stay with
    ``keep_repeats``.
    """
    entries = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e, i: F.transform(
                e["value"], lambda p: F.struct(p.alias("pos"), i.alias("nth"), e["key"].alias("word"))
            ),
        )
    )
    ordered = F.array_sort(entries)
    if keep_repeats:
        return F.coalesce(F.array_join(F.transform(ordered, lambda x: x["word"]), " "), F.lit(""))
    following = F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(0)))
    last_on_position = F.zip_with(
        ordered,
        following,
        lambda x, nxt: F.when(nxt.isNull() | (nxt["pos"] != x["pos"]), x["word"]),
    )
    return F.coalesce(F.array_join(last_on_position, " "), F.lit(""))


def work_defaults(df: DataFrame, on_missing_title: str = "untitled") -> DataFrame:
    """CLN-10: title, abstract and citation-count defaults.

    ``untitled`` fills a missing title; ``drop`` falls back to display_name and
    drops the work if that is missing too.
    """
    if on_missing_title == "drop":
        df = df.withColumn("title", F.coalesce(F.col("title"), F.col("display_name")))
        df = df.filter(F.col("title").isNotNull())
    else:
        df = df.withColumn("title", F.coalesce(F.col("title"), F.lit("(untitled)")))
    return df.withColumn("abstract", F.coalesce(F.col("abstract"), F.lit(""))).withColumn(
        "cited_by_count", F.coalesce(F.col("cited_by_count"), F.lit(0))
    )


def pdf_url(oa_url: Column, pdf: Column, doi: Column) -> Column:
    """CLN-11: open-access URL, else PDF URL, else the DOI as a URL."""
    return F.coalesce(
        F.nullif(oa_url, F.lit("")),
        F.nullif(pdf, F.lit("")),
        F.concat(F.lit("https://doi.org/"), clean_doi(doi)),
    )


def variant_path(c: Column, path: str, kind: str = "string", default: object = None) -> Column:
    """CLN-12: nested get with a default; an empty object counts as missing."""
    value = F.try_variant_get(c, path, kind)
    if kind == "string":
        value = F.nullif(value, F.lit("{}"))
    return value if default is None else F.coalesce(value, F.lit(default))


def string_list(c: Column) -> Column:
    """CLN-12: a VARIANT holding a string or a list of strings, as a list."""
    many = F.try_variant_get(c, "$", "array<string>")
    one = F.try_variant_get(c, "$", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def topic_source(topics: Column, concepts: Column, rule: str = "key_present") -> Column:
    """CLN-13: which list describes the subject of a work.

    first5: topics unless empty, else the first five concepts.
    all: topics unless empty, else all concepts.
    key_present: topics whenever the field exists, even when empty.
    """
    if rule == "key_present":
        return F.when(topics.isNotNull(), topics).otherwise(concepts)
    fallback = F.slice(concepts, 1, 5) if rule == "first5" else concepts
    return F.when(F.size(topics) > 0, topics).otherwise(fallback)


def slugify(c: Column, n: int = 80) -> Column:
    """CLN-15: keep letters, digits, dash, underscore, CJK."""
    s = F.regexp_replace(strip(c), r"[^0-9A-Za-z_\-一-鿿]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.substring(F.when(s == "", F.lit("item")).otherwise(s), 1, n)


def file_name_part(c: Column, n: int = 80) -> Column:
    """CLN-15, the news form: no trimming of underscores, no placeholder."""
    return F.substring(F.regexp_replace(c, r"[^0-9A-Za-z_\-一-鿿]+", "_"), 1, n)


def iso_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.date_format(c, "yyyy-MM-dd")


def normalise_for_index(df: DataFrame) -> DataFrame:
    """CLN-16: column types a search index takes, chosen from the schema."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = iso_text(c, f.dataType)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.decode(c, "UTF-8")
        elif isinstance(f.dataType, T.StringType):
            c = F.when(
                c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), F.regexp_replace(c, r"^(\S+) ", "$1T")
            ).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def flat_props(df: DataFrame, keys: list[str]) -> DataFrame:
    """CLN-17: routing keys, scalar properties as JSON, and a full JSON copy."""
    scalars = []
    for f in df.schema.fields:
        kind = f.dataType
        plain = not isinstance(kind, (T.StructType, T.MapType, T.ArrayType))
        if isinstance(kind, T.ArrayType):
            plain = not isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType))
        if plain:
            scalars.append(f.name)
    return df.select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys],
        F.to_json(F.struct(*scalars)).alias("props"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("properties_json"),
    )


def flag(c: Column) -> Column:
    """CLN-18: 0/1 to boolean, unknown is false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def venue_biblio(volume: Column, issue: Column) -> Column:
    """CLN-19: 'Vol.x, No.y' from what is known."""
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("Vol."), F.nullif(volume, F.lit(""))),
        F.concat(F.lit("No."), F.nullif(issue, F.lit(""))),
    )
    return F.nullif(parts, F.lit(""))


def page_range(first: Column, last: Column) -> Column:
    """CLN-19: 'first-last', or the first page alone."""
    first, last = F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))
    return F.coalesce(F.concat(first, F.lit("-"), last), first)


def perspectives(df: DataFrame, question: str = "question", words: str = "keywords") -> DataFrame:
    """CLN-21: one row per research facet for each question (six facets)."""
    facet = F.explode(F.array(*[F.lit(p) for p in fixed.PERSPECTIVES]))
    return df.withColumn("name", facet).select(
        *df.columns,
        "name",
        F.concat_ws(" ", question, "name").alias("retrieval_question"),
        F.concat(F.slice(words, 1, 6), F.array("name")).alias("facet_keywords"),
        F.when(F.col("name") == "applications", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("news"), F.lit("blog"))).alias("exclude_terms"),
        F.when(F.col("name") == "recent trends", F.lit("recent 5 years"))
        .otherwise(F.lit("all years")).alias("time_range"),
    )


# --- predicates --------------------------------------------------------------


def split_valid(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-01: rows with all required fields, and the rejects with a reason."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in required])
    marked = df.withColumn("reject_reason", missing)
    return (
        marked.filter("reject_reason = ''").drop("reject_reason"),
        marked.filter("reject_reason <> ''"),
    )


def matches_plan(
    topics: Column, year: Column, kind: Column, topic_ids: list[str], years: tuple[int, int], work_type: str
) -> Column:
    """FLT-02: any of the topics, inside the years, of the type."""
    cond = year.between(*years) & (kind == work_type)
    if topic_ids:
        cond = cond & F.exists(topics, lambda t: t["id"].isin(topic_ids))
    return cond


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """FLT-03: rows whose key is in a table of wanted ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def updated_since(df: DataFrame, since: str, column: str = "updated_at") -> DataFrame:
    """FLT-04: changed rows; the comparison reaches the parquet scan."""
    return df.filter(F.col(column) > F.lit(since).cast(df.schema[column].dataType))


EDGE_THRESHOLDS = {"ABOUT": 0.0, "HAS_TOPIC": 0.3}  # FLT-05, fixed values


def search_filter(
    text: Column, terms: list[str], year: Column, min_year: int, venues: Column, venue_name: str
) -> Column:
    """FLT-06: all terms in the text, a year range, and a nested venue name."""
    has_terms = reduce(lambda a, b: a & b, [F.lower(text).contains(t.lower()) for t in terms])
    return has_terms & (year >= min_year) & F.exists(venues, lambda v: v["name"] == venue_name)
