"""Benchmark passages that are cut off at the start or the end of a text."""

import random

import pytest

from paperloom.llm import decontaminate
from paperloom.llm.batches import prepare
from tests.llm.helpers import awkward

ITEM = "seventeen purple elephants recite long poetry to a bewildered audience of penguins near the lake"


@pytest.mark.parametrize("cut", range(1, 6))
def test_passages_without_their_first_characters(spark, cut):
    rng = random.Random(cut)
    filler = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    window = ITEM[: decontaminate.WINDOW]
    texts = [window[cut:] + " " + filler(), filler(), window[cut:] + " " + filler(), filler(), filler() + " " + window[:-cut], filler()]
    session = prepare(spark)
    docs = awkward(session, texts).coalesce(1)
    bench = session.createDataFrame([(1, window)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {0, 2, 4}
    assert got[0]["start"] == got[2]["start"] == 0 and got[4]["end"] <= len(texts[4])
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [1, 3, 5]


def test_no_alignment_over_the_end_of_a_text(spark):
    session = prepare(spark)
    window = ITEM[: decontaminate.WINDOW]
    at = window.index(" ", 30)
    docs = awkward(session, [window[:at], window[at + 1 :]]).coalesce(1)
    bench = session.createDataFrame([(1, window)], "item_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench).count() == 2
