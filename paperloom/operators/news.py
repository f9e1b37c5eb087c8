"""News-text pipeline (NWS-*): wide sheet to cells, clean documents, chunks, scores.

Everything per document stays in its row as arrays; only ranking and numbering
exchange data.
"""

from __future__ import annotations

import html
import re
from functools import reduce
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import fixed
from paperloom.functions.clean import file_name_part
from paperloom.functions.text import BLANK, strip
from paperloom.operators.skew import numbered, top_n
from paperloom.session import cut, pin

# --- fixed values: gate, chunk and score parameters -------------------------------------
MIN_CHARS, MIN_CJK_RATIO = 80, 0.35
PARENT_MAX, PARENT_MIN = 1200, 300
CHILD_WINDOW, CHILD_MAX = 1, 600
CANDIDATE_SCORE = 2.0


# --- sheet to cells -----------------------------------------------------------------------


def text_columns(columns: list[str], pattern: str = r"news\d+_text") -> list[str]:
    """NWS-01: text columns in the order of their number."""
    found = [c for c in columns if re.match(pattern, c)]
    if not found:
        raise ValueError(f"no column matches {pattern}")

    def number(c: str) -> int:
        m = re.search(r"news(\d+)_text", c)
        return int(m.group(1)) if m else 10**9

    return sorted(found, key=number)


def pick_column(columns: list[str], candidates: list[str], wanted: str | None = None) -> str | None:
    """NWS-01: the id or label column: the wanted one, else the first known name."""
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"column {wanted} does not exist")
        return wanted
    return next((c for c in candidates if c in columns), None)


def collapse(c: Column) -> Column:
    """All white space runs to one blank, trimmed."""
    return strip(F.regexp_replace(c, rf"[{BLANK}]+", " "))


def news_cells(sheet: DataFrame, row_index: str, id_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """NWS-02 / NWS-18: one row per non-empty cell; the id column keeps its name."""
    columns = text_columns(sheet.columns)
    id_name = pick_column(sheet.columns, fixed.ID_COLUMNS, id_col)
    label = pick_column(sheet.columns, fixed.LABEL_COLUMNS, label_col)
    keys = sheet.select(
        F.col(row_index).alias("row_index"),
        F.col(id_name or row_index).cast("string").alias("sample_id"),
        (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
        *columns,
    )
    long = keys.unpivot(["row_index", "sample_id", "label"], columns, "news_col", "raw_text")
    rows = long.withColumn("raw_text", collapse("raw_text")).filter(F.coalesce("raw_text", F.lit("")) != "")
    digest = F.sha1("raw_text")
    out = rows.select(
        "row_index", "sample_id", F.lit(id_name or "row_index").alias("id_col_name"), "label", "news_col",
        digest.alias("text_hash"),
        F.concat(F.lit("r"), "row_index", F.lit("_"), file_name_part(F.col("news_col")), F.lit("_"), F.substring(digest, 1, 10)).alias("occurrence_id"),
        "raw_text", F.length("raw_text").alias("char_len"),
    )
    return out.withColumn(id_name, F.col("sample_id")) if id_name else out


# --- cleaning ---------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def html_unescape(c: Column) -> Column:
    """HTML entities to characters. Spark has no such function; only texts with an
    ampersand travel to Python, in Arrow batches."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def normalise(c: Column, unescape: bool = True) -> Column:
    """NWS-03: BOM, entities, wide and zero-width blanks, line ends, blank runs."""
    c = F.replace(c, F.lit("\ufeff"), F.lit(""))
    if unescape:
        c = html_unescape(c)
    c = F.regexp_replace(c, "\u3000", " ")
    c = F.regexp_replace(c, "[\u200b\u200c\u200d\ufeff]", "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def remove_boilerplate(c: Column) -> Column:
    """NWS-04"""
    return reduce(lambda t, p: F.regexp_replace(t, "(?s)" + p, " "), fixed.BOILERPLATE, c)


def scrub(c: Column) -> Column:
    """NWS-05: URLs, e-mail, IPv4, long hex and phone numbers out; blank lines dropped."""
    for pattern in (
        fixed.URL_PATTERN, fixed.EMAIL_PATTERN, fixed.IPV4_PATTERN, fixed.LONG_HEX_PATTERN, fixed.PHONE_PATTERN,
    ):
        c = F.regexp_replace(c, pattern, " ")
    lines = F.transform(F.split(c, "\n"), lambda s: strip(F.regexp_replace(s, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def cjk_ratio(c: Column) -> Column:
    """NWS-06"""
    return (F.length(c) - F.length(F.regexp_replace(c, "[一-鿿]", ""))) / F.greatest(F.length(c), F.lit(1))


def is_bad_page(c: Column) -> Column:
    """NWS-07"""
    return c.rlike("(?i)" + fixed.BAD_PAGE)


def any_term(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def is_multi_company(c: Column) -> Column:
    """NWS-08: a list word and at least five company words."""
    return any_term(c, fixed.LIST_MARKERS) & (F.regexp_count(c, F.lit(fixed.COMPANY_WORD)) >= 5)


def clean_documents(
    cells: DataFrame, raw: str = "raw_text", min_chars: int = MIN_CHARS, min_ratio: float = MIN_CJK_RATIO, unescape: bool = True
) -> DataFrame:
    """NWS-09: clean text, flags and the first matching drop reason.

    A bad page is judged on the normalised raw text; the other tests see the
    cleaned text, which is empty for a bad page.
    """
    d = pin(cells.withColumn("_norm", normalise(F.col(raw), unescape)), is_bad_page=is_bad_page(F.col("_norm")))
    body = scrub(remove_boilerplate(F.col("_norm")))
    d = pin(d, clean_text=F.when(F.col("is_bad_page"), F.lit("")).otherwise(body))
    text = F.col("clean_text")
    d = pin(d, clean_len=F.length(text), _ratio=cjk_ratio(text), raw_len=F.length("_norm"))
    short, low = F.col("clean_len") < min_chars, F.col("_ratio") < min_ratio
    reason = F.when(F.col("is_bad_page"), "bad_page").when(short, "too_short").when(low, "low_chinese_ratio")
    return d.select(
        *cells.columns, "raw_len", "clean_len", F.round("_ratio", 4).alias("chinese_ratio"), "is_bad_page",
        short.alias("is_too_short"), low.alias("is_low_chinese_ratio"),
        any_term(text, fixed.NOTICE_TERMS).alias("is_notice_like"), is_multi_company(text).alias("is_multi_company_like"),
        reason.alias("drop_reason"), "clean_text",
    )


# --- sentences and chunks -------------------------------------------------------------------


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, "\n+"), strip)
    return F.filter(parts, lambda p: F.length(p) >= 4)


def zh_sentences(c: Column) -> Column:
    """NWS-10: split after closing marks; over 350 characters also after commas."""
    parts = F.transform(F.split(F.regexp_replace(c, "[ \t]+", " "), rf"(?<=[。！？!?；;])[{BLANK}]*"), strip)
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.length(p) > 350, F.transform(F.split(p, rf"(?<=[，,、])[{BLANK}]*"), strip)).otherwise(F.array(p)),
        )
    )
    return F.filter(pieces, lambda s: F.length(s) >= 4)


def sentence_records(c: Column) -> Column:
    """NWS-11: array<struct<paragraph_index, sentence>>; the array position is the sentence index."""
    return F.flatten(
        F.transform(
            paragraphs(c),
            lambda p, i: F.transform(zh_sentences(p), lambda s: F.struct(i.alias("paragraph_index"), s.alias("sentence"))),
        )
    )


def parent_numbers(records: Column) -> Column:
    """NWS-12: the parent of each sentence, by a greedy fold over the document.

    A parent closes when the next sentence would pass the maximum, or opens a new
    paragraph after the minimum.
    """
    small = F.transform(records, lambda r: F.struct(F.length(r["sentence"]).alias("n"), r["paragraph_index"].alias("p")))
    start = F.struct(
        F.lit(0).alias("len"), F.lit(-1).alias("para"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, r: Column) -> Column:
        close = (s["len"] > 0) & (
            (s["len"] + r["n"] > PARENT_MAX) | ((r["p"] != s["para"]) & (s["len"] >= PARENT_MIN))
        )
        no = s["no"] + close.cast("int")
        return F.struct(
            (F.when(close, F.lit(0)).otherwise(s["len"]) + r["n"]).alias("len"), r["p"].alias("para"), no.alias("no"),
            F.concat(s["out"], F.array(no)).alias("out"),
        )

    return F.aggregate(small, start, step, lambda s: s["out"])


def with_sentences(docs: DataFrame) -> DataFrame:
    """Clean documents with their sentence records and parent numbers."""
    recs = pin(docs, _recs=sentence_records(F.col("clean_text")))
    return pin(recs, _parent=parent_numbers(F.col("_recs")))


def parent_chunks(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """NWS-12: (doc, parent_index, start_sentence, end_sentence, parent_text)."""
    d = with_sentences(docs).filter(F.size("_recs") > 0)
    rows = d.select(
        doc, "_recs", "_parent", F.explode(F.sequence(F.lit(0), F.element_at("_parent", -1))).alias("parent_index")
    ).withColumn("_first", F.array_position("_parent", F.col("parent_index")).cast("int")).withColumn(
        "_n", F.size(F.filter("_parent", lambda p: p == F.col("parent_index")))
    )
    text = F.array_join(F.slice(F.col("_recs.sentence"), F.col("_first"), F.col("_n")), "")
    return rows.select(
        F.concat(doc, F.lit("_p"), F.lpad(F.col("parent_index").cast("string"), 4, "0")).alias("parent_id"), doc, "parent_index",
        (F.col("_first") - 1).alias("start_sentence"), (F.col("_first") + F.col("_n") - 2).alias("end_sentence"),
        F.length(text).alias("text_len"), text.alias("parent_text"),
    )


def count_hits(c: Column, terms: list[str]) -> Column:
    """NWS-14: distinct lexicon terms found; a sum of substring tests compiles to plain code."""
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms])


def found_terms(c: Column, terms: list[str]) -> Column:
    """NWS-14: the places in ``terms`` of those found, ascending.

    A substring test per term reads a text as often as there are terms. Here the places
    where a term may begin are found once for a whole Arrow batch, by one look-up per
    character, and only they are compared.
    """
    if "" in terms:
        raise ValueError("an empty term")
    signs = [np.array([ord(x) for x in t], np.uint32) for t in terms]
    group = {x: n for n, x in enumerate(sorted({int(t[0]) for t in signs}))}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        plain = ["" if x is None else x for x in texts.to_pylist()]
        end = np.cumsum([len(x) + 1 for x in plain], dtype=np.int64)  # each text with a sign behind it that no term has
        code = np.frombuffer("".join(x + "\ud800" for x in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.full(0x110000, -1, np.int16)
        begins[list(group)] = list(group.values())
        kind = begins[code]
        at = np.flatnonzero(kind >= 0)
        at = at[np.argsort(kind[at], kind="stable")]
        first = np.searchsorted(kind[at], np.arange(len(group) + 1))
        row = np.searchsorted(end, at, "right")
        there = np.zeros((len(plain), len(terms)), bool)
        for n, term in enumerate(signs):
            g = group[int(term[0])]
            place, of = at[first[g] : first[g + 1]], row[first[g] : first[g + 1]]
            for k in range(1, len(term)):
                same = code[np.minimum(place + k, len(code) - 1)] == term[k]
                place, of = place[same], of[same]
            there[of, n] = True
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(there)[1].astype(np.int32)))
        return pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type)) if texts.null_count else lists

    return run(c)


def hit_terms(c: Column, terms: list[str]) -> Column:
    """NWS-14: the terms found, in lexicon order."""
    listed = F.array(*[F.lit(t) for t in terms])
    return F.transform(found_terms(c, terms), lambda i: F.get(listed, i))


def scored(children: DataFrame) -> DataFrame:
    """NWS-15: rule score, tags and the candidate flag.

    Expects child_text, center_sentence, doc_notice, doc_multi.
    """
    text = F.col("child_text")
    lists = [fixed.NEGATIVE_TERMS, fixed.POSITIVE_TERMS, fixed.FINANCIAL_TERMS, fixed.NOTICE_TERMS, fixed.LIST_MARKERS]
    center = [fixed.NEGATIVE_TERMS, fixed.FINANCIAL_TERMS]

    def counted(found: str, lexicons: list[list[str]]) -> list[Column]:
        """How many terms of each lexicon are among the places ``found`` in all of them."""
        def within(a: int, b: int) -> Column:
            return F.size(F.filter(found, lambda i: (i >= a) & (i < b)))

        return [within(a, b) for a, b in pairwise(accumulate(map(len, lexicons), initial=0))]

    d = children.withColumn("_in_text", found_terms(text, sum(lists, []))).withColumn(
        "_in_center", found_terms(F.col("center_sentence"), sum(center, []))
    )
    neg, pos, fin, notice, listed = counted("_in_text", lists)
    center_neg, center_fin = counted("_in_center", center)
    companies = F.when(listed > 0, F.regexp_count(text, F.lit(fixed.COMPANY_WORD)) >= 5).otherwise(False)
    d = pin(
        d, _neg=neg, _pos=pos, _fin=fin,
        is_notice_like=(notice > 0) | F.col("doc_notice"),
        is_multi_company_like=companies | F.col("doc_multi"),
        amount_count=F.regexp_count(text, F.lit(fixed.AMOUNT_PATTERN)),
        date_count=F.regexp_count(text, F.lit(fixed.DATE_PATTERN)),
        _cneg=center_neg > 0, _cfin=center_fin > 0,
    ).drop("_in_text", "_in_center")

    def upto(c: str, n: int) -> Column:
        return F.least(F.col(c), F.lit(n))

    neg, fin, pos = F.col("_neg") > 0, F.col("_fin") > 0, F.col("_pos") > 0
    zero = F.lit(0.0)
    parts = [
        F.when(neg, 3.0 + upto("_neg", 5) * 0.5).otherwise(zero),
        F.when(fin, 1.5 + upto("_fin", 5) * 0.3).otherwise(zero),
        F.when(pos, 0.8 + upto("_pos", 5) * 0.15).otherwise(zero),
        F.when(F.col("is_notice_like"), 0.2).otherwise(zero),
        F.when(F.col("is_multi_company_like"), -0.3).otherwise(zero),
        upto("amount_count", 3) * 0.4,
        upto("date_count", 3) * 0.15,
        F.when(F.col("_cneg"), 1.0).otherwise(zero),
        F.when(F.col("_cfin"), 0.5).otherwise(zero),
        F.when(F.col("is_notice_like") & ~neg & ~fin & (F.col("amount_count") == 0), -0.5).otherwise(zero),
    ]
    score = F.round(F.greatest(reduce(lambda a, b: a + b, parts), zero), 3)
    tags = F.array_sort(F.array_compact(F.array(
        F.when(neg, "negative"), F.when(fin, "financial"), F.when(pos, "positive"),
        F.when(F.col("is_notice_like"), "notice_like"), F.when(F.col("is_multi_company_like"), "multi_company_like"),
        F.when(F.col("amount_count") > 0, "amount"), F.when(F.col("date_count") > 0, "date"),
    )))
    return pin(d, rule_score=score, rule_tags=tags).withColumn(
        "is_candidate", F.col("rule_score") >= CANDIDATE_SCORE
    ).drop("_neg", "_pos", "_fin", "_cneg", "_cfin", "doc_notice", "doc_multi")


def child_chunks(docs: DataFrame, doc: str = "doc_id", window: int = CHILD_WINDOW, max_chars: int = CHILD_MAX) -> DataFrame:
    """NWS-13: each sentence with its neighbours, cut to size, linked to its parent."""
    d = with_sentences(docs).select(
        doc, "is_notice_like", "is_multi_company_like", F.col("_recs.sentence").alias("_s"), "_parent"
    ).withColumn("_n", F.size("_s"))
    rows = d.filter("_n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("sentence_index"))
    i = F.col("sentence_index")
    lo = F.greatest(i - window, F.lit(0))
    hi = F.least(i + window + 1, F.col("_n"))
    return rows.select(
        F.concat(doc, F.lit("_c"), F.lpad(i.cast("string"), 4, "0")).alias("child_id"), doc, "sentence_index",
        F.get("_parent", i).alias("parent_index"), F.get("_s", i).alias("center_sentence"),
        F.substring(F.array_join(F.slice("_s", lo + 1, hi - lo), ""), 1, max_chars).alias("child_text"),
        F.col("is_notice_like").alias("doc_notice"), F.col("is_multi_company_like").alias("doc_multi"),
    )


def top_candidates(children: DataFrame, doc: str = "doc_id", n: int = 3) -> DataFrame:
    """WIN-03: the n best candidate chunks of each document."""
    return top_n(children.filter("is_candidate"), [doc], [F.desc("rule_score"), F.asc("sentence_index")], n, "rank")


def embedding_index(children: DataFrame, order: list[str]) -> DataFrame:
    """NWS-16: a dense 0-based row number over the selected chunks."""
    # A range exchange reads its input twice, the first time for its bounds; so the chunks are made before.
    return numbered(cut(children, "indexed-chunks"), order, name="_n", label="embedding-index").withColumn(
        "embedding_row", F.col("_n") - 1
    ).drop("_n")


def parse_responses(c: Column) -> Column:
    """NWS-17: stored model answers as VARIANT: plain JSON, fenced JSON, first object."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.try_parse_json(strip(c)), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit("")))
    )
