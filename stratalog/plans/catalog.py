"""All queries of the core with the SQL that checks them."""

from __future__ import annotations

from stratalog.operators import changefeed, hierarchy, orphans
from stratalog.plans import more_queries, problems, registry, report_queries, search_queries, source_queries, store_queries, upkeep_queries  # noqa: F401


def queries() -> dict:
    return {
        "p2_found": orphans.p2_found,
        "p2_report": orphans.p2_report,
        "p5_found": hierarchy.p5_found,
        "p5_paths": hierarchy.p5_paths,
        "p5_descendants": hierarchy.p5_descendants,
        "p6_found": changefeed.p6_found,
        "p6_counts": changefeed.p6_counts,
        **registry.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**problems.SQL, **registry.SQL}


def flagship(spark, sf_dir: str):
    return search_queries.r27_recall(spark, sf_dir)
