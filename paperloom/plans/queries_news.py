"""News-text queries (NWS-*, AGG-13, WIN-03).

The documents hold no Chinese, so their letters are mapped to characters that
also spell lexicon terms; both engines apply the same mapping.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.operators import aggregates as A
from paperloom.operators import news as N
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import spread

LETTERS = "etaonihsrdlucmwfgypbvkjxqz.,"
SIGNS = "债违公评司利约润务告亏级中元单增长名投厂集团企业万亿。，"

BL = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BL}+|{BL}+$', '', 'g')"


ZH = f"translate(text, '{LETTERS}', '{SIGNS}')"
SHEET_SQL = f"""
  SELECT d.doc_id, quality, {ZH} AS news1_text, CASE WHEN d.doc_id % 5 = 0 THEN '   ' ELSE source || '  ' || lang END AS news2_text,
    CASE WHEN d.doc_id % 7 = 0 THEN 'access denied ' || text END AS news10_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def zh(c):
    return F.translate(c, LETTERS, SIGNS)


def sheet(spark, sf):
    labels = V.table(spark, sf, "labels").select("doc_id", "quality")
    d = spread(V.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")).join(labels, "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        i.alias("row_index"), i.alias("duty_id"), F.col("quality").alias("is_replace"),
        F.when(i % 7 == 0, F.concat(F.lit("access denied "), "text")).alias("news10_text"),
        F.when(i % 5 == 0, F.lit("   ")).otherwise(F.concat_ws("  ", "source", "lang")).alias("news2_text"),
        zh("text").alias("news1_text"),
    )


CELLS_SQL = f"""
  cells AS MATERIALIZED (SELECT row_index, label, news_col, t, sha1(t) AS text_hash, 'r' || row_index || '_' || news_col || '_' || left(sha1(t), 10) AS occurrence_id FROM (
    SELECT doc_id AS row_index, quality::VARCHAR AS label, news_col, {trim_sql(f"regexp_replace(raw, '{BL}+', ' ', 'g')")} AS t FROM (
      SELECT doc_id, quality, 'news1_text' AS news_col, news1_text AS raw FROM sheet UNION ALL SELECT doc_id, quality, 'news2_text', news2_text FROM sheet
      UNION ALL SELECT doc_id, quality, 'news10_text', news10_text FROM sheet) WHERE raw IS NOT NULL) WHERE t <> '')
"""
HEAD = f"WITH sheet AS ({SHEET_SQL}), {CELLS_SQL}"


@query("nws02_cells", HEAD + " SELECT row_index, row_index::VARCHAR AS duty_id, label, news_col, text_hash, occurrence_id, length(t)::INTEGER AS char_len FROM cells")
def nws02(spark, sf):
    return N.news_cells(sheet(spark, sf), "row_index").select("row_index", "duty_id", "label", "news_col", "text_hash", "occurrence_id", "char_len")


@query("nws03_normalise", f"""
  SELECT page_id, md5({trim_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[\x{200b}-\x{200d}\x{feff}]', '', 'g')")}) AS text_md5
  FROM (SELECT page_id, regexp_replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM pages)""")
def nws03(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(N.normalise(F.col("html"))).alias("text_md5"))


def boiler_sql(c: str) -> str:
    for p in fixed.BOILERPLATE:
        c = f"regexp_replace({c}, '(?s){p}', ' ', 'g')"
    return c


TAIL = "。来源：记者 责任编辑：某某；投资者据此操作，风险自担。免责声明：本文仅供参考。尾"


@query("nws04_boilerplate", f"SELECT doc_id, md5({boiler_sql(ZH + f''' || '{TAIL}' ''')}) AS text_md5 FROM documents")
def nws04(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(N.remove_boilerplate(F.concat(zh("text"), F.lit(TAIL)))).alias("text_md5"))


def scrub_sql(c: str) -> str:
    for p in (fixed.URL_PATTERN, fixed.EMAIL_PATTERN, fixed.IPV4_PATTERN, r"\b[a-fA-F0-9]{20,}\b", fixed.PHONE_PATTERN):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    line = trim_sql("regexp_replace(s, '[ \\t]+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda s: {line}), lambda s: s <> ''), chr(10))"


@query("nws05_scrub", f"SELECT doc_id, md5({scrub_sql('text')}) AS text_md5 FROM documents")
def nws05(spark, sf):
    return spread(V.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(N.scrub(F.col("text"))).alias("text_md5"))


def norm_sql(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return trim_sql(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def terms_sql(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def multi_sql(c: str) -> str:
    return f"({terms_sql(c, fixed.LIST_MARKERS)} AND len(regexp_extract_all({c}, '{fixed.COMPANY_WORD}')) >= 5)"


# Three kinds of news text per document: mapped, plain, and an error page.
NEWS_SQL = f"""
  raw AS (SELECT 'd' || doc_id AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'ACCESS denied ' || text WHEN doc_id % 6 = 0 THEN text ELSE {ZH} || ' 名单 2024年1月2日' END AS raw FROM documents),
  nrm AS MATERIALIZED (SELECT doc_id, {norm_sql("raw")} AS n FROM raw),
  bad AS (SELECT doc_id, n, regexp_matches(n, '(?i){fixed.BAD_PAGE}') AS is_bad FROM nrm),
  cl AS MATERIALIZED (SELECT doc_id, n, is_bad, CASE WHEN is_bad THEN '' ELSE {scrub_sql(boiler_sql("n"))} END AS c FROM bad),
  docs AS MATERIALIZED (SELECT doc_id, n, is_bad, c, (length(c) - length(regexp_replace(c, '[一-鿿]', '', 'g'))) / greatest(length(c), 1) AS ratio,
      {terms_sql("c", fixed.NOTICE_TERMS)} AS notice, {multi_sql("c")} AS multi FROM cl),
  gate AS MATERIALIZED (SELECT *, CASE WHEN is_bad THEN 'bad_page' WHEN length(c) < 80 THEN 'too_short' WHEN ratio < 0.35 THEN 'low_chinese_ratio' END AS reason FROM docs)
"""


def news_docs(spark, sf):
    i = F.col("doc_id")
    raw = (
        F.when(i % 11 == 0, F.concat(F.lit("ACCESS denied "), "text")).when(i % 6 == 0, F.col("text"))
        .otherwise(F.concat(zh("text"), F.lit(" 名单 2024年1月2日")))
    )
    d = spread(V.table(spark, sf, "documents").select("doc_id", "text"))
    return N.clean_documents(d.select(F.concat(F.lit("d"), i).alias("doc_id"), raw.alias("raw_text")))


@query("nws09_gate", f"""WITH {NEWS_SQL}
  SELECT doc_id, length(n)::INTEGER AS raw_len, length(c)::INTEGER AS clean_len, round(ratio, 4) AS chinese_ratio, notice AS is_notice_like, multi AS is_multi_company_like, reason AS drop_reason, md5(c) AS clean_md5 FROM gate""")
def nws09(spark, sf):
    return news_docs(spark, sf).select(
        "doc_id", "raw_len", "clean_len", "chinese_ratio", "is_notice_like", "is_multi_company_like", "drop_reason", F.md5("clean_text").alias("clean_md5"))


@query("agg13_counters", f"""WITH {NEWS_SQL}
  SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n_docs, sum(length(n))::BIGINT AS raw_chars, sum(length(c))::BIGINT AS clean_chars FROM gate GROUP BY 1""")
def agg13(spark, sf):
    return A.pipeline_counters(news_docs(spark, sf))


def kept(spark, sf):
    return news_docs(spark, sf).filter("drop_reason IS NULL").select("doc_id", "clean_text", "is_notice_like", "is_multi_company_like")


SENT_SQL = NEWS_SQL + rf""",
  para AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS paragraph_index FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(c, '\n+'), lambda s: {trim_sql("s")}), lambda s: length(s) >= 4) AS p FROM gate WHERE reason IS NULL)),
  s1 AS (SELECT doc_id, paragraph_index, unnest(q) AS t, generate_subscripts(q, 1) AS i FROM (
    SELECT doc_id, paragraph_index, list_transform(string_split(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '([。！？!?；;]){BL}*', '\1' || chr(1), 'g'), chr(1)), lambda s: {trim_sql("s")}) AS q FROM para)),
  s2 AS (SELECT doc_id, paragraph_index, i, unnest(q) AS t, generate_subscripts(q, 1) AS j FROM (
    SELECT doc_id, paragraph_index, i, CASE WHEN length(t) > 350 THEN list_transform(string_split(regexp_replace(t, '([，,、]){BL}*', '\1' || chr(1), 'g'), chr(1)), lambda s: {trim_sql("s")}) ELSE [t] END AS q FROM s1)),
  sent AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, i, j) - 1 AS si, paragraph_index, t FROM s2 WHERE length(t) >= 4)
"""


@query("nws10_sentences", f"WITH {SENT_SQL} SELECT doc_id, si::INTEGER AS sentence_index, paragraph_index::INTEGER AS paragraph_index, t AS sentence FROM sent")
def nws10(spark, sf):
    d = kept(spark, sf).select("doc_id", F.posexplode(N.sentence_records(F.col("clean_text"))).alias("sentence_index", "r"))
    return d.select("doc_id", "sentence_index", "r.paragraph_index", "r.sentence")


# The greedy fold as a recursion over sentences: one step per sentence index.
PARENT_SQL = SENT_SQL + """,
  fold AS (SELECT doc_id, si, paragraph_index AS para, length(t) AS cur, 0 AS no FROM sent WHERE si = 0
    UNION ALL SELECT s.doc_id, s.si, s.paragraph_index,
      CASE WHEN f.cur + length(s.t) > 1200 OR (s.paragraph_index <> f.para AND f.cur >= 300) THEN length(s.t) ELSE f.cur + length(s.t) END,
      f.no + CASE WHEN f.cur + length(s.t) > 1200 OR (s.paragraph_index <> f.para AND f.cur >= 300) THEN 1 ELSE 0 END
    FROM fold f JOIN sent s ON s.doc_id = f.doc_id AND s.si = f.si + 1)
"""


@query("nws12_parents", f"""WITH RECURSIVE {PARENT_SQL}
  SELECT f.doc_id || '_p' || lpad(no::VARCHAR, 4, '0') AS parent_id, f.doc_id, no::INTEGER AS parent_index, min(f.si)::INTEGER AS start_sentence, max(f.si)::INTEGER AS end_sentence,
    sum(length(t))::INTEGER AS text_len, md5(string_agg(t, '' ORDER BY f.si)) AS text_md5 FROM fold f JOIN sent s ON s.doc_id = f.doc_id AND s.si = f.si GROUP BY f.doc_id, no""")
def nws12(spark, sf):
    p = N.parent_chunks(kept(spark, sf))
    return p.select("parent_id", "doc_id", "parent_index", "start_sentence", "end_sentence", "text_len", F.md5("parent_text").alias("text_md5"))


def hits_sql(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{t}')::INTEGER" for t in terms) + ")"


CHILD_SQL = SENT_SQL + f""",
  kid AS MATERIALIZED (SELECT doc_id, si, t AS center, left(coalesce(lag(t) OVER w, '') || t || coalesce(lead(t) OVER w, ''), 600) AS x FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY si)),
  feat AS MATERIALIZED (SELECT k.*, {hits_sql("x", fixed.NEGATIVE_TERMS)} AS neg, {hits_sql("x", fixed.POSITIVE_TERMS)} AS pos, {hits_sql("x", fixed.FINANCIAL_TERMS)} AS fin,
    ({terms_sql("x", fixed.NOTICE_TERMS)} OR notice) AS nt, ({multi_sql("x")} OR multi) AS mc,
    len(regexp_extract_all(x, '{fixed.AMOUNT_PATTERN}')) AS am, len(regexp_extract_all(x, '{fixed.DATE_PATTERN}')) AS dt,
    {terms_sql("center", fixed.NEGATIVE_TERMS)} AS cneg, {terms_sql("center", fixed.FINANCIAL_TERMS)} AS cfin
    FROM kid k JOIN gate g ON g.doc_id = k.doc_id),
  sco AS MATERIALIZED (SELECT *, round(greatest(CASE WHEN neg > 0 THEN 3.0 + least(neg, 5) * 0.5 ELSE 0 END + CASE WHEN fin > 0 THEN 1.5 + least(fin, 5) * 0.3 ELSE 0 END
    + CASE WHEN pos > 0 THEN 0.8 + least(pos, 5) * 0.15 ELSE 0 END + CASE WHEN nt THEN 0.2 ELSE 0 END - CASE WHEN mc THEN 0.3 ELSE 0 END + least(am, 3) * 0.4 + least(dt, 3) * 0.15
    + CASE WHEN cneg THEN 1.0 ELSE 0 END + CASE WHEN cfin THEN 0.5 ELSE 0 END - CASE WHEN nt AND neg = 0 AND fin = 0 AND am = 0 THEN 0.5 ELSE 0 END, 0), 3)::DOUBLE AS score FROM feat)
"""


@query("nws13_children", f"WITH {CHILD_SQL} SELECT doc_id || '_c' || lpad(si::VARCHAR, 4, '0') AS child_id, si::INTEGER AS sentence_index, center AS center_sentence, md5(x) AS text_md5 FROM kid")
def nws13(spark, sf):
    c = N.child_chunks(kept(spark, sf))
    return c.select("child_id", "sentence_index", "center_sentence", F.md5("child_text").alias("text_md5"))


@query("nws14_hits", f"""WITH {CHILD_SQL} SELECT doc_id || '_c' || lpad(si::VARCHAR, 4, '0') AS child_id,
  array_to_string(list_filter([{", ".join(f"'{t}'" for t in fixed.NEGATIVE_TERMS + fixed.FINANCIAL_TERMS)}], lambda t: contains(x, t)), ',') AS hits, am::INTEGER AS amounts, dt::INTEGER AS dates FROM feat""")
def nws14(spark, sf):
    text = F.col("child_text")
    return N.child_chunks(kept(spark, sf)).select(
        "child_id", F.array_join(N.hit_terms(text, fixed.NEGATIVE_TERMS + fixed.FINANCIAL_TERMS), ",").alias("hits"),
        F.regexp_count(text, F.lit(fixed.AMOUNT_PATTERN)).alias("amounts"), F.regexp_count(text, F.lit(fixed.DATE_PATTERN)).alias("dates"))


def scored(spark, sf):
    return N.scored(N.child_chunks(kept(spark, sf)))


@query("nws15_scores", f"""WITH {CHILD_SQL} SELECT doc_id || '_c' || lpad(si::VARCHAR, 4, '0') AS child_id, score AS rule_score, score >= 2.0 AS is_candidate,
  concat_ws(',', CASE WHEN am > 0 THEN 'amount' END, CASE WHEN dt > 0 THEN 'date' END, CASE WHEN fin > 0 THEN 'financial' END, CASE WHEN mc THEN 'multi_company_like' END,
    CASE WHEN neg > 0 THEN 'negative' END, CASE WHEN nt THEN 'notice_like' END, CASE WHEN pos > 0 THEN 'positive' END) AS tags FROM sco""")
def nws15(spark, sf):
    return scored(spark, sf).select("child_id", "rule_score", "is_candidate", F.array_join("rule_tags", ",").alias("tags"))


@query("win03_top_chunks", f"""WITH {CHILD_SQL} SELECT doc_id, si::INTEGER AS sentence_index, score AS rule_score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, si) AS rank FROM sco WHERE score >= 2.0) WHERE rank <= 3""")
def win03(spark, sf):
    return N.top_candidates(scored(spark, sf)).select("doc_id", "sentence_index", "rule_score", "rank")


@query("nws16_embedding_index", f"""WITH {CHILD_SQL} SELECT doc_id || '_c' || lpad(si::VARCHAR, 4, '0') AS child_id, row_number() OVER (ORDER BY doc_id, si) - 1 AS embedding_row FROM sco WHERE score >= 2.0""")
def nws16(spark, sf):
    c = scored(spark, sf).filter("is_candidate").select("child_id", "doc_id", "sentence_index")
    return N.embedding_index(c, ["doc_id", "sentence_index"]).select("child_id", "embedding_row")


@query("nws17_responses", """
  SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role, CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text)::INTEGER END AS n FROM conversations""")
def nws17(spark, sf):
    c = V.table(spark, sf, "conversations")
    body = F.to_json(F.struct("role", F.length("text").alias("n")))
    t = F.col("turn") % 4
    answer = (
        F.when(t == 0, body).when(t == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(t == 2, F.concat(F.lit("Answer "), body, F.lit(" as asked"))).otherwise(F.lit("none"))
    )
    v = N.parse_responses(answer)
    return c.select("conv_id", "turn", F.try_variant_get(v, "$.role", "string").alias("role"), F.try_variant_get(v, "$.n", "int").alias("n"))
