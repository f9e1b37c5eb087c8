"""Which parts of a page count as beside its article (operator 7)."""

import time

import pytest
from pyspark.sql import functions as F

from paperloom.llm import extract

BODY = "<p>The river rose in the night and the town was warned.</p>"
TEXT = "The river rose in the night and the town was warned."
PRIORS = extract.Weights({})


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<form id=all><nav>Home Menu</nav><article><h1>Flood</h1>{BODY}</article></form>", f"Flood\n{TEXT}"),
        (f"<form action=/x><div>{BODY}{BODY}</div></form>", f"{TEXT}\n{TEXT}"),
        (f"<div class='content-sidebar-wrap'><article>{BODY}</article><aside>More news</aside></div>", TEXT),
        (f"<div class=sidebar><article class=teaser><p>Weather today</p></article></div><article>{BODY}</article>", TEXT),
        (f"<article><div class='article-header'><h1>Flood</h1></div>{BODY}</article>", f"Flood\n{TEXT}"),
        (f"<article>{BODY}<div class='related-work'>{BODY}</div></article>", f"{TEXT}\n{TEXT}"),
        (f"<article>{BODY}<div class='related-posts'>Ten other floods</div></article>", TEXT),
        (f"<article>{BODY}<div class='adSlot-2'>Buy boots</div><form>Your mail</form></article>", TEXT),
        (f"<div class='has-sidebar'>{BODY}</div>", TEXT),
        (f"<article>{BODY}</article><section><article class=comment><p>{'so true ' * 40}</p></article></section>", TEXT),
        (f"<div data-class=ad>{BODY}</div>", TEXT),
        ("<footer><p>All rights reserved</p></footer>", ""),
    ],
)
def test_parts(page, want):
    assert extract.main_text(page, PRIORS) == want


def test_open_and_unmatched_tags_take_linear_time():
    def took(n):
        start = time.perf_counter()
        extract.main_text("<div class=ad>" * n + "</b>" * n, PRIORS)
        return time.perf_counter() - start

    took(1_000)
    assert took(16_000) < 16 * max(took(2_000), 0.02)


def test_repeated_rows_long_pages_and_clashing_names(spark):
    long = f"<article>{BODY * 5_000}</article>"
    given = [(1, long), (1, long), (2, None), (3, "")]
    docs = spark.createDataFrame(given, "page_id long, html string").withColumn("text", F.lit("old")).withColumn("k0", F.lit(7))
    got = sorted((r["page_id"], r["text"], r["k0"]) for r in extract.extracted(docs, PRIORS).collect())
    whole = "\n".join([TEXT] * 5_000)
    assert got == [(1, whole, 7), (1, whole, 7), (2, "", 7), (3, "", 7)]
