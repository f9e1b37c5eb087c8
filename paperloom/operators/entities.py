"""Entities and links out of nested work records (ENT-*, LNK-*).

Every function reads the parsed works frame and is one projection over it, so
Catalyst prunes the nested columns each table does not need. A ``seq`` column
gives the input order where "first record wins".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.clean import (
    LENGTHS, abstract_text, clean_doi, clean_orcid, clean_string, entity_id, normalize_id,
    page_range, string_list, topic_source, venue_biblio, venue_issns,
)
from paperloom.functions.text import strip
from paperloom.operators.skew import first_per_key


def with_work_id(raw: DataFrame) -> DataFrame:
    """Valid works only, with the normalised key."""
    return raw.withColumn("work_id", normalize_id(F.col("id"))).filter("work_id <> ''")


def work_fields() -> dict[str, Column]:
    """The columns of a work row."""
    abstract = F.coalesce(F.nullif("abstract", F.lit("")), abstract_text(F.col("abstract_inverted_index")), F.lit(""))
    return {
        "title": F.coalesce(clean_string(F.col("title"), LENGTHS["title"]), F.lit("(untitled)")),
        "abstract": abstract,
        "publication_year": F.col("publication_year"),
        "publication_date": F.col("publication_date"),
        "cited_by_count": F.coalesce("cited_by_count", F.lit(0)),
        "doi": clean_string(F.col("doi")),
        "open_access_pdf_url": F.coalesce(F.nullif("open_access.oa_url", F.lit("")), "pdf_url"),
        "type_name": F.coalesce(F.nullif("type", F.lit("")), "type_crossref"),
    }


def named(fields: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in fields.items()]


def works(raw: DataFrame) -> DataFrame:
    """ENT-01: the relational work row."""
    return with_work_id(raw).select("work_id", *named(work_fields()), "seq")


def _authorships(raw: DataFrame) -> DataFrame:
    a = with_work_id(raw).select(
        "work_id", "seq", F.posexplode("authorships").alias("author_order", "a")
    )
    return a.select(
        "work_id", "seq", "author_order", "a",
        entity_id(F.col("a.author.id")).alias("author_id"),
        clean_string(F.col("a.author.display_name"), LENGTHS["author"]).alias("display_name"),
    ).filter("author_id IS NOT NULL AND display_name IS NOT NULL")


def authors(raw: DataFrame) -> DataFrame:
    """ENT-02"""
    a = _authorships(raw).select(
        "author_id", "display_name", clean_orcid(F.col("a.author.orcid")).alias("orcid"),
        "seq", "author_order",
    )
    return first_per_key(a, ["author_id"], ["seq", "author_order"], ["display_name", "orcid"])


def institution_fields(i: Column) -> dict[str, Column]:
    """The columns of an institution, from one entry of an authorship."""
    return {
        "institution_id": entity_id(i["id"]),
        "display_name": clean_string(i["display_name"], LENGTHS["institution"]),
        "type": clean_string(i["type"], LENGTHS["type"]),
        "country_code": clean_string(i["country_code"], LENGTHS["country"]),
        "ror": clean_string(i["ror"], LENGTHS["ror"]),
    }


def _institution_rows(raw: DataFrame) -> DataFrame:
    rows = _authorships(raw).select(
        "work_id", "seq", "author_order", "author_id",
        affiliation_strings(F.col("a")).alias("strings"),
        F.posexplode("a.institutions").alias("inst_pos", "i"),
    )
    return rows.select(
        "work_id", "seq", "author_order", "author_id", "inst_pos", "strings", *named(institution_fields(F.col("i"))),
    ).filter("institution_id IS NOT NULL AND display_name IS NOT NULL")


def institutions(raw: DataFrame) -> DataFrame:
    """ENT-03"""
    return first_per_key(
        _institution_rows(raw).drop("strings", "work_id", "author_id"),
        ["institution_id"],
        ["seq", "author_order", "inst_pos"],
        ["display_name", "type", "country_code", "ror"],
    )


def concept_fields(c: Column) -> dict[str, Column]:
    """The columns of a concept, from one entry of a work."""
    return {
        "concept_id": entity_id(c["id"]),
        "display_name": clean_string(c["display_name"], LENGTHS["concept"]),
        "level": F.coalesce(c["level"], F.lit(0)),
        "score": F.coalesce(c["score"], F.lit(0.0)),
    }


def _concept_rows(raw: DataFrame) -> DataFrame:
    chosen = topic_source(F.col("topics"), F.col("concepts"), "key_present")
    rows = with_work_id(raw).select(
        "work_id", "seq",
        F.when(F.size("topics") > 0, "topics").otherwise("concepts").alias("source"),
        F.posexplode(chosen).alias("pos", "c"),
    )
    return rows.select("work_id", "seq", "pos", "source", *named(concept_fields(F.col("c")))).filter(
        "concept_id IS NOT NULL AND display_name IS NOT NULL"
    )


def concepts(raw: DataFrame) -> DataFrame:
    """ENT-04"""
    return first_per_key(
        _concept_rows(raw), ["concept_id"], ["seq", "pos"], ["display_name", "level", "score"]
    )


def venue_fields(source: Column) -> dict[str, Column]:
    """The columns of a venue, from the source of a location."""
    return {
        "venue_id": entity_id(source["id"]),
        "display_name": clean_string(source["display_name"], LENGTHS["venue"]),
        "issn_l": clean_string(source["issn_l"], LENGTHS["issn_l"]),
        "issn": F.filter(string_list(source["issn"]), lambda s: s != ""),
        "publisher": clean_string(source["publisher"], LENGTHS["publisher"]),
        "is_open_access": F.coalesce(source["is_oa"], F.lit(False)),
        "country_code": clean_string(source["country_code"], LENGTHS["country"]),
    }


def place_fields(biblio: Column) -> dict[str, Column]:
    """Where in its primary venue a work stands."""
    return {
        "volume": biblio["volume"],
        "issue": biblio["issue"],
        "volume_issue": venue_biblio(biblio["volume"], biblio["issue"]),
        "pages": page_range(biblio["first_page"], biblio["last_page"]),
    }


def _venue_rows(raw: DataFrame, secondary: bool = False) -> DataFrame:
    places = F.array("primary_location")
    if secondary:
        places = F.concat(places, F.coalesce("locations", F.slice(places, 1, 0)))
    rows = with_work_id(raw).select(
        "work_id", "seq", "biblio", F.posexplode(places).alias("pos", "l")
    )
    return rows.select(
        "work_id", "seq", "pos", "biblio",
        (F.col("pos") == 0).alias("is_primary"), *named(venue_fields(F.col("l.source"))),
    ).filter("venue_id IS NOT NULL AND display_name IS NOT NULL")


def venues(raw: DataFrame, secondary: bool = False) -> DataFrame:
    """ENT-05: from the primary location; optionally from the others too."""
    rows = _venue_rows(raw, secondary).withColumn("x", venue_issns(F.col("issn_l"), F.col("issn")))
    rows = rows.select("*", "x.issn_print", "x.issn_online").drop("x")
    return first_per_key(
        rows, ["venue_id"], ["seq", "pos"],
        ["display_name", "issn_l", "issn_print", "issn_online", "publisher", "is_open_access"],
    )


def countries(raw: DataFrame, with_venues: bool = False) -> DataFrame:
    """ENT-06"""
    codes = _institution_rows(raw).select("country_code")
    if with_venues:
        codes = codes.unionByName(_venue_rows(raw, True).select("country_code"))
    return codes.filter("country_code IS NOT NULL").distinct()


def work_types(raw: DataFrame) -> DataFrame:
    """ENT-07"""
    kind = F.coalesce(F.nullif("type", F.lit("")), "type_crossref")
    return with_work_id(raw).select(kind.alias("type_name")).filter(strip(F.col("type_name")) != "").distinct()


def work_authors(raw: DataFrame, order_base: int = 0) -> DataFrame:
    """LNK-01"""
    return _authorships(raw).select(
        "work_id", "author_id",
        (F.col("author_order") + order_base).alias("author_order"),
        F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"),
        F.col("a.author_position").alias("author_position"),
    ).dropDuplicates(["work_id", "author_id", "author_order"])


def author_institutions(raw: DataFrame) -> DataFrame:
    """LNK-02"""
    return _institution_rows(raw).select("author_id", "institution_id").distinct()


def work_institutions(raw: DataFrame) -> DataFrame:
    """LNK-03"""
    return _institution_rows(raw).select("work_id", "institution_id").distinct()


def affiliation_strings(authorship: Column) -> Column:
    """LNK-04: both places that carry affiliation text, trimmed, distinct."""
    plain = F.transform(string_list(authorship["raw_affiliation_strings"]), strip)
    nested = F.transform(
        F.coalesce(authorship["affiliations"]["raw_affiliation_string"], F.array().cast("array<string>")),
        strip,
    )
    return F.array_distinct(F.filter(F.concat(plain, nested), lambda s: s.isNotNull() & (s != "")))


def work_author_affiliations(raw: DataFrame) -> DataFrame:
    """LNK-04: institutions times affiliation strings; NULL if there is none."""
    rows = _institution_rows(raw).select(
        "work_id", "author_id", "institution_id", "author_order",
        F.explode_outer("strings").alias("raw_affiliation_string"),
    )
    return first_per_key(
        rows, ["work_id", "author_id", "institution_id", "raw_affiliation_string"], ["author_order"]
    )


def work_concepts(raw: DataFrame) -> DataFrame:
    """LNK-05"""
    return first_per_key(
        _concept_rows(raw), ["work_id", "concept_id"], ["pos"], ["score", "source"]
    )


def work_venues(raw: DataFrame, secondary: bool = False) -> DataFrame:
    """LNK-06"""
    rows = _venue_rows(raw, secondary).select(
        "work_id", "venue_id", "pos", "is_primary",
        *[F.when(F.col("is_primary"), c).alias(name) for name, c in place_fields(F.col("biblio")).items()],
    )
    return first_per_key(
        rows, ["work_id", "venue_id"], ["pos"], ["is_primary", "volume", "issue", "volume_issue", "pages"]
    )


def citations(raw: DataFrame) -> DataFrame:
    """LNK-07"""
    return with_work_id(raw).select(
        F.col("work_id").alias("citing_work_id"), F.explode("referenced_works").alias("r")
    ).select("citing_work_id", normalize_id(F.col("r")).alias("cited_work_id")).distinct()


def work_author_institutions(raw: DataFrame) -> DataFrame:
    """LNK-08: three-way link, 1-based order; no institution, no row."""
    rows = _authorships(raw).select(
        "work_id", "author_id", (F.col("author_order") + 1).alias("author_order"),
        F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"),
        F.explode("a.institutions").alias("i"),
    )
    return rows.select(
        "work_id", "author_id", entity_id(F.col("i.id")).alias("institution_id"),
        "author_order", "is_corresponding",
    ).filter("institution_id IS NOT NULL").distinct()


def ordered_unique(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """LNK-10: first row per key."""
    return first_per_key(df, key, order)


def clean_batch(raw: DataFrame) -> dict[str, DataFrame]:
    """LNK-09: every entity and link table of one batch of works."""
    return {
        "works": works(raw), "authors": authors(raw), "institutions": institutions(raw),
        "concepts": concepts(raw), "venues": venues(raw), "countries": countries(raw),
        "work_types": work_types(raw), "work_authors": work_authors(raw),
        "author_institutions": author_institutions(raw), "work_institutions": work_institutions(raw),
        "work_author_affiliations": work_author_affiliations(raw),
        "work_concepts": work_concepts(raw), "work_venues": work_venues(raw),
        "citations": citations(raw),
    }


def batch_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-12: rows per table of a batch."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def demo_work_row(raw: DataFrame) -> DataFrame:
    """CLN-05/06/10, the stricter variant: bare DOI, parsed date, title required."""
    from paperloom.functions.clean import parse_partial_date, work_defaults

    w = work_defaults(with_work_id(raw), "drop")
    return w.select(
        "work_id", "title", clean_doi(F.col("doi")).alias("doi"),
        parse_partial_date(F.col("publication_date")).alias("publication_date"),
    )
