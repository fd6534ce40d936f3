"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliant.plans import q_search, registry  # noqa: E402
from foliant.plans.world import World  # noqa: E402
from foliant.session import get_session  # noqa: E402

HEADLINE = (
    "flagship_most_read_works", "k01_normalize_text", "k11_slugify", "s05_filter_editions", "s12_flatten_volumes", "f02_select_works", "x01_extract_works", "x03_popularity",
    "g01_resolve_redirects", "g02_cluster_authors", "e01_find_duplicates", "e10_resolve_ladder", "e18_pick_representative", "l04_rung3", "l06_candidates",
    "l09_fold_series", "l16_assign_slugs", "l22_reading_order", "n02_infer_genres", "n06_genre_summary", "n07_apply_genre_votes", "n09_top_genres",
    "d02_vote_scores", "d07_apply_shelf_log", "d08_profile_shelves", "q01_build_search_index", "q03_rank_search", "c08_merge_works", "r02_undoable", "a07_suspicious_series",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
                        spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='foliant-')}")  # one machine
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["k12_row_id"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    timings = {}
    for name in only:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        world = World(spark, folder)
        path = q_search.store_ranked(world)  # a search on a ready index: building it is q01
        start = time.time()
        q_search.search_stored(world, path).write.format("noop").mode("overwrite").save()
        timings["q03_stored_search"] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
