"""Declared schemas. JSON is always read with one of these, never inferred."""

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
V = T.VariantType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def array(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


INSTITUTION = struct(id=S, display_name=S, type=S, country_code=S, ror=S)
AUTHORSHIP = struct(
    author=struct(id=S, display_name=S, orcid=S),
    author_position=S,
    is_corresponding=B,
    institutions=array(INSTITUTION),
    raw_affiliation_strings=V,  # a string or a list of strings
    affiliations=array(struct(raw_affiliation_string=S)),
)
TOPIC = struct(id=S, display_name=S, score=D, level=I)
LOCATION = struct(
    source=struct(
        id=S, display_name=S, issn_l=S, issn=V, publisher=S,
        host_organization_name=S, homepage_url=S, country_code=S, is_oa=B,
    )
)
WORK = struct(
    id=S, doi=S, title=S, display_name=S, abstract=S,
    abstract_inverted_index=T.MapType(S, array(I)),
    publication_year=I, publication_date=S, type=S, type_crossref=S, cited_by_count=I,
    authorships=array(AUTHORSHIP),
    topics=array(TOPIC),
    concepts=array(TOPIC),
    primary_location=LOCATION,
    locations=array(LOCATION),
    biblio=struct(volume=S, issue=S, first_page=S, last_page=S),
    referenced_works=array(S),
    open_access=struct(oa_url=S),
    pdf_url=S,
    updated_at=S,
)

CHANGE = struct(
    operation=S, table=S, data=V, old_data=V, timestamp=T.TimestampType(),
)
MAXWELL = struct(database=S, table=S, type=S, ts=T.LongType(), data=V, old=V)

# Natural keys of the stored tables, and the columns an upsert overwrites.
TABLE_KEYS = {
    "works": ["work_id"],
    "authors": ["author_id"],
    "institutions": ["institution_id"],
    "concepts": ["concept_id"],
    "venues": ["venue_id"],
    "countries": ["country_code"],
    "work_types": ["type_name"],
    "work_authors": ["work_id", "author_id", "author_order"],
    "author_institutions": ["author_id", "institution_id"],
    "work_institutions": ["work_id", "institution_id"],
    "work_author_affiliations": ["work_id", "author_id", "institution_id", "raw_affiliation_string"],
    "work_concepts": ["work_id", "concept_id"],
    "work_venues": ["work_id", "venue_id"],
    "citations": ["citing_work_id", "cited_work_id"],
    "external_work_refs": ["external_work_id"],
    "corpus_membership": ["corpus_id", "work_id", "membership_source"],
    "crawl_frontier": ["corpus_id", "work_id"],
}
