import __spark_entry__ as entry
from trustframe.plans.registry import all_plans


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 80 and set(oracles) <= set(queries)
    out = entry.entry(spark)
    assert out.columns == ["check", "code", "issues"] and out.count() > 0


def test_every_query_analyses(spark, small):
    # queries that run jobs while they are built are covered by their own tests
    eager = {"lineage_levels", "lineage_cycles", "lineage_audit", "one_to_one_match", "transient_trend_stream", "registry_roundtrip",
             "csv_strict", "publish_check", "issue_report", "late_observations", "boundary_sets", "bindings_by_selector", "input_partition",
             "extract_values", "extraction_status", "near_duplicate_cells", "near_duplicate_count", "keyed_xml", "page_files"}
    for name, plan in all_plans().items():
        if name not in eager:
            assert plan.run(spark, small).columns, name
