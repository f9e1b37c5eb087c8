"""Chunks, vectors, news and state operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import aggregates as A
from paperloom.operators import chunks as K
from paperloom.operators import news as N
from paperloom.operators import sets as S
from paperloom.operators import upsert as U
from paperloom.operators import vectors as E
from paperloom.sources import tables as T
from paperloom.streaming import changes as L
from tests.conftest import rows


def chunk_by_hand(body, size=8, step=6):
    """Parents and children of one section, straight from the definition."""
    out, n = [], 0
    for start in range(0, len(body), step):
        for j in range(start, min(start + size, len(body))):
            out.append((n, " ".join(body[max(0, j - 1): j + 2])))
            n += 1
    return out


@pytest.mark.parametrize("n", [1, 6, 7, 8, 13, 20])
def test_children(spark, n):
    body = [f"Sentence number {i} of this text here." for i in range(n)]
    text = "# Head\n" + " ".join(body)
    d = spark.createDataFrame([("W1", text)], "work_id string, text string")
    got = sorted((r["child_index"], r["text"]) for r in K.child_chunks(d).collect())
    assert got == chunk_by_hand(body)
    parents = K.parent_chunks(d).orderBy("parent_index").collect()
    assert parents[-1]["end_child_index"] == len(got) - 1
    assert [p["start_child_index"] for p in parents[1:]] == [p["end_child_index"] + 1 for p in parents[:-1]]


def test_child_index_runs_over_sections(spark):
    s = "A first sentence of some length. A second sentence of some length."
    d = spark.createDataFrame([("W1", f"{s}\n# Two\n{s}")], "work_id string, text string")
    c = K.child_chunks(d, buckets=64).orderBy("child_index").collect()
    assert [(r["child_index"], r["section"]) for r in c] == [(0, "body"), (1, "body"), (2, "Two"), (3, "Two")]
    assert c[1]["char_start"] == 33 and c[1]["token_start"] == 6
    assert c[0]["token_end"] == 12 == len(c[0]["buckets"])


def test_search_and_verify(spark):
    d = spark.createDataFrame([
        ("W1", "Graph learning methods for citation data. Another filler sentence is here."),
        ("W2", "Cooking pasta with fresh tomatoes today. Boil water before adding the salt."),
    ], "work_id string, text string")
    c = K.child_chunks(d)
    ev = K.search_evidence(c, ["graph learning citation", "pasta tomatoes"], 1)
    assert {(r["query_no"], r["work_id"]) for r in ev.collect()} == {(0, "W1"), (1, "W2")}
    sup = K.verify_claim(ev, "graph learning")
    assert {(r["work_id"], r["support_status"]) for r in sup.collect()} == {("W1", "supports"), ("W2", "uncertain")}
    with_b = K.search_evidence(K.child_chunks(d, buckets=64), ["graph learning citation", "pasta tomatoes"], 1)
    assert rows(with_b, "evidence_id", "retrieval_score") == rows(ev, "evidence_id", "retrieval_score")
    only = K.search_evidence(c, ["graph"], 5, spark.createDataFrame([("W2",)], "work_id string"))
    assert {r["work_id"] for r in only.collect()} == {"W2"}


def test_source_pack(spark):
    kp = spark.createDataFrame([("W1", "T1", 0.9, "bridge_paper", 2020), ("W2", "T2", 0.8, "x", 2021), ("W3", "T3", 0.7, "x", None)],
                               "work_id string, title string, score double, role string, publication_year int")
    ev = spark.createDataFrame([("W1", "C1", "text", 0.5), ("W1", "C2", "better", 0.6)], "work_id string, child_id string, child_text string, retrieval_score double")
    w = spark.createDataFrame([("W2", "abstract")], "work_id string, abstract string")
    pack = K.source_pack(kp, ev, w).orderBy("nth").collect()
    assert [(r["citation_id"], r["source_type"], r["snippet"]) for r in pack] == [
        ("E1", "evidence_bundle", "better"), ("E2", "corpus_abstract", "abstract"), ("E3", "graph_key_paper", "")]


def test_vectors(spark):
    v = spark.createDataFrame([("c", "a", [1.0, 0.0], "x"), ("c", "b", [0.6, 0.8], "y"), ("c", "z", [0.0, 0.0], "y")],
                              "collection string, id string, embedding array<float>, kind string")
    assert [r["id"] for r in E.search(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r["id"] for r in E.search(v, [1.0, 0.0], 1, F.col("kind") == "y").collect()] == ["b"]
    assert E.search(v, [1.0, 0.0], 1, F.col("kind") == "y", filter_first=False).count() == 0
    new = E.append(v, spark.createDataFrame([("c", "a", [0.0, 1.0], "n")], v.schema), "overwrite")
    assert rows(new.filter("id = 'a'"), "kind") == [("n",)] and new.count() == 3
    out = E.embed(v, "kind", lambda: (lambda batch: [[float(len(t))] for t in batch]))
    assert {r["embedding"][0] for r in out.collect()} == {1.0}


# --- news -------------------------------------------------------------------------------------

RISK = "公司因债务违约被法院列为被执行人，涉及金额3亿元。" * 4
LIST = "公示名单 序号 单位名称：甲公司、乙公司、丙公司、丁公司、戊企业。" + "2024年1月2日公告内容如下，请查阅附件材料说明。" * 4


@pytest.fixture(scope="module")
def docs(spark):
    data = [
        ("bad", "访问行为存在异常 请稍后"), ("short", "太短"), ("latin", "only latin letters " * 10), ("risk", RISK + "\n" + RISK), ("list", LIST),
        ("ent", "&amp;&#20013;" + "中文内容很多。" * 20),
    ]
    return N.clean_documents(spark.createDataFrame(data, "doc_id string, raw_text string"))


def test_gate(docs):
    got = {r["doc_id"]: (r["drop_reason"], r["is_notice_like"], r["is_multi_company_like"]) for r in docs.collect()}
    assert got["bad"][0] == "bad_page" and got["short"][0] == "too_short" and got["latin"][0] == "low_chinese_ratio"
    assert got["risk"] == (None, False, False) and got["list"] == (None, True, True)
    assert docs.filter("doc_id = 'ent'").first()["clean_text"].startswith("&中")


def test_news_chunks(docs):
    kept = docs.filter("drop_reason IS NULL")
    p = N.parent_chunks(kept).filter("doc_id = 'risk'").collect()
    assert len(p) == 1 and p[0]["start_sentence"] == 0 and p[0]["end_sentence"] == 7
    c = N.scored(N.child_chunks(kept))
    risk = c.filter("doc_id = 'risk' AND sentence_index = 0").first()
    # neg: 债务 违约 被执行 -> 3 + 1.5; two amounts 0.8; centre 1.0
    assert risk["rule_score"] == pytest.approx(6.3) and risk["rule_tags"] == ["amount", "negative"]
    assert N.top_candidates(c).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    idx = N.embedding_index(c, ["doc_id", "sentence_index"])
    assert sorted(r["embedding_row"] for r in idx.collect()) == list(range(c.count()))


def test_greedy_parents(spark):
    recs = [(300, 0), (100, 0), (100, 1), (1100, 1), (200, 1), (50, 2)]
    d = spark.createDataFrame([(1,)], "i int").select(
        F.array(*[F.struct(F.lit(p).alias("paragraph_index"), F.lit("x" * n).alias("sentence")) for n, p in recs]).alias("r"))
    got = d.select(N.parent_numbers(F.col("r")).alias("g")).first()["g"]
    want, cur, para, no = [], 0, None, 0
    for n, p in recs:
        if cur and (cur + n > 1200 or (p != para and cur >= 300)):
            no, cur = no + 1, 0
        want.append(no)
        cur, para = cur + n, p
    assert got == want


def test_cells(spark):
    sheet = spark.createDataFrame([(0, "a1", 1, "x  y", " ", "z"), (1, "a2", None, None, "x y", None)],
                                  "row_index int, duty_id string, is_replace int, news2_text string, news10_text string, news1_text string")
    assert N.text_columns(sheet.columns) == ["news1_text", "news2_text", "news10_text"]
    cells = N.news_cells(sheet, "row_index")
    assert rows(cells, "sample_id", "label", "news_col", "raw_text", "duty_id") == [
        ("a1", "1", "news1_text", "z", "a1"), ("a1", "1", "news2_text", "x y", "a1"), ("a2", None, "news10_text", "x y", "a2")]
    s = A.sample_summary(cells, ["row_index", "sample_id", "label"]).filter("label IS NULL").first()
    assert (s["non_empty_news_count"], s["total_chars"]) == (1, 3)
    assert rows(A.unique_texts(cells), "occurrence_count") == [(1,), (2,)]


def test_scrub(spark):
    text = "see https://a.b/c and www.x.y mail me@x.org ip 10.0.0.1 id deadbeefdeadbeefdead1 end\n\n  \nkeep 电话：010-1234567 "
    got = spark.range(1).select(N.scrub(F.lit(text)).alias("t")).first()["t"]
    assert got == "see and mail ip id end\nkeep"


# --- state -----------------------------------------------------------------------------------


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("k", 1, 10, 5)], "key string, v int, ver int, made int")
    new = spark.createDataFrame([("k", 2, 11, 11), ("k", 0, 9, 9), ("n", 7, 1, 1)], "key string, v int, ver int, made int")
    once = U.upsert(old, new, ["key"], ["v"], "ver", "made")
    assert rows(once) == [("k", 2, 11, 5), ("n", 7, 1, 1)]
    assert rows(U.upsert(once, new, ["key"], ["v"], "ver", "made")) == rows(once)


def test_keys_and_frontier(spark):
    known = spark.createDataFrame([("a", 5)], "n string, k long")
    got = dict(rows(U.assign_keys(known, spark.createDataFrame([("b",), ("c",), ("a",)], "n string"), "n", "k")))
    assert got == {"a": 5, "b": 6, "c": 7}
    f = U.frontier_upsert(spark.createDataFrame([("w", 3, "completed")], "id string, depth int, status string"),
                          spark.createDataFrame([("w", 1), ("x", 2)], "id string, depth int"), ["id"])
    assert rows(f) == [("w", 1, "completed"), ("x", 2, "pending")]


def test_first_non_empty(spark):
    empty, one, two = (spark.createDataFrame(d, "id int") for d in ([], [(1,)], [(2,)]))
    assert rows(S.first_non_empty([empty, one, two])) == [(1, 1)]


def test_change_forms(spark):
    native = '{"operation": "insert", "table": "works", "data": {"id": 1}, "timestamp": "2024-01-01T00:00:00"}'
    maxwell = '{"database": "d", "table": "works", "type": "delete", "ts": 1702546800, "data": {"id": 1}, "old": null}'
    debezium = '{"op": "u", "before": {"id": 1}, "after": {"id": 2}, "source": {"table": "works"}, "ts_ms": 1702546800000}'
    for form, line, op in (("native", native, "INSERT"), ("maxwell", maxwell, "DELETE"), ("debezium", debezium, "UPDATE")):
        r = L.parse_changes(spark.createDataFrame([(line,), ("{broken",)], "value string"), form=form).collect()
        assert (r[0]["operation"], r[0]["ok"], r[1]["ok"]) == (op, True, False)


def test_state_ignores_late_and_repeated_events(spark):
    log = spark.createDataFrame([
        ("INSERT", 1, 10, "a"), ("UPDATE", 1, 30, "c"), ("UPDATE", 1, 20, "b"), ("UPDATE", 1, 30, "c"), ("INSERT", 2, 5, "x"), ("DELETE", 2, 6, None),
    ], "operation string, id int, t int, v string").withColumn("ts", F.timestamp_seconds("t"))
    got = rows(L.current_state(log, ["id"], ["v"]), "id", "v", "is_deleted")
    assert got == [(1, "c", False), (2, "x", True)]


def test_fan_out(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(5).selectExpr("id", "'t' AS table", "id < 4 AS ok").write.parquet(str(src))
    stream = spark.readStream.schema("id long, table string, ok boolean").parquet(str(src))
    sinks = {n: (lambda df, b, n=n: df.write.mode("overwrite").parquet(str(tmp_path / n / f"batch={b}"))) for n in ("a", "b")}
    L.fan_out(stream, sinks, str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_export_and_dictionary(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, cast(null AS string) AS b, array(1,2) AS c, cast('x' AS binary) AS d, date'2024-01-02' AS e")
    m = T.export_csv({"t": df}, str(tmp_path / "out")).first()
    assert (m["row_count"], m["total_rows"], m["columns"]) == (1, 1, ["a", "b", "c", "d", "e"])
    assert tuple(T.csv_values(df).first()) == ("1", "", "[1,2]", "x", "2024-01-02")
    assert T.data_dictionary({"t": df}).count() == 5


def test_binary_store(spark, tmp_path):
    for n, body in (("a", b"same"), ("b", b"same"), ("c", b"other")):
        (tmp_path / f"{n}.pdf").write_bytes(body)
    store, links = T.store_binaries(spark, str(tmp_path))
    assert (store.count(), links.count()) == (2, 3)


def test_plan(spark):
    data = [("W1", 0, 2010, "T1", 2.0), ("W2", 1, 2024, "T1", 2.0), ("W3", 2, 2022, "T2", 0.5)]
    raw = spark.createDataFrame(data, "id string, seq long, publication_year int, t string, s double")
    topic = F.array(F.struct(F.col("t").alias("id"), F.col("t").alias("display_name"), F.col("s").alias("score"), F.lit(0).alias("level")))
    raw = raw.select("id", "seq", "publication_year", topic.alias("topics"), F.slice(topic, 1, 0).alias("concepts"))
    p = A.download_plan(raw, 10, 2.0).first()
    assert p["recommended_filter"] == "topics.id:T1,publication_year:2012-2024,type:article"
    assert p["seed_ids"] == "W1|W2|W3"


def test_wide_csv(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('﻿duty_id,news1_text\na1,"line one\nline ""two"""\n', encoding="utf-8")
    got = T.read_wide_csv(spark, str(f))
    assert got.columns == ["duty_id", "news1_text"] and rows(got) == [("a1", 'line one\nline "two"')]
    g = tmp_path / "g.csv"
    g.write_bytes("duty_id,news1_text\na1,违约\n".encode("gbk"))
    assert rows(T.read_wide_csv(spark, str(g), "GBK"), "news1_text") == [("违约",)]
