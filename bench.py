"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paperloom.plans import load_all  # noqa: E402
from paperloom.session import drop_cuts, local_session  # noqa: E402

HEADLINE = [
    "gra06_key_papers", "gra02_pagerank", "gra03_components", "gra04_labels", "gra01_edges", "gra09_typed_edges",
    "ent01_works", "ent02_authors", "lnk04_affiliations", "lnk07_citations", "lnk09_batch_counts",
    "jn01_fk_resolution", "jn04_external_refs", "agg07_author_counts", "agg10_research_areas", "ups01_upsert",
    "idx01_work_docs", "idx06_search", "txt04_children", "txt08_search", "vec02_topk",
    "nws09_gate", "nws15_scores", "bfs01_layers", "crp01_search", "str02_apply_changes", "dsn05_topic_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load_all()
    spark = local_session(cpus, memory="16g", app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        drop_cuts(spark)
    works = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    out = {
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }
    if "lnk09_batch_counts" in times:
        out["clean_works_per_second"] = round(works / times["lnk09_batch_counts"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
