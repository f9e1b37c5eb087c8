"""The pipeline's near-copies go through the SimHash of operator 6 as well."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import minhash
from paperloom.llm.batches import prepare
from paperloom.session import cut
from tests.llm.test_near_copies import plain_set


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def test_simhash_proposes_pairs_without_a_common_band(session):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**5)}" for _ in range(4000)]
    near = words[:2000] + ["other"] + words[2001:]
    far = [f"v{rng.randrange(10**5)}" for _ in range(300)]
    texts = [" ".join(words), " ".join(near), " ".join(far), "", "one", None]
    docs = session.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "row string, doc_id long, text string")
    prints = cut(minhash.hashed(docs))
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(
        F.min("row").alias("row"), F.first("size").alias("size"), F.first("simhash").alias("simhash")
    )
    nodes = nodes.withColumn("bands", F.array(F.col("fp")))  # no band in common
    got = {(r["src"], r["dst"]) for r in minhash.links(nodes, docs.select("row", "text")).collect()}
    fp = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert len(plain_set(texts[0]) & plain_set(texts[1])) * 5 > 4 * len(plain_set(texts[0]) | plain_set(texts[1]))
    assert got == {tuple(sorted((fp[0], fp[1])))}


def test_equal_simhash_is_no_link_by_itself(session):
    docs = session.createDataFrame([(str(i), i, t) for i, t in enumerate(["a b c d e f", "g h i j k l m", "n o"])], "row string, doc_id long, text string")
    prints = cut(minhash.hashed(docs))
    nodes = prints.select(F.col("fingerprint").alias("fp"), "row", "size", "bands", F.lit(7).cast("long").alias("simhash"))
    assert minhash.simhash_pairs(nodes).count() == 2
    assert minhash.links(nodes, docs.select("row", "text")).count() == 0
