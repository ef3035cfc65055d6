"""Queries over test sources, test output and benchmark lines, made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import reports
from .registry import register


def _suites(spark, sf_dir):
    return schema.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.concat(F.lit("s"), F.col("c_custkey")).alias("suite"))


_C = "c AS (SELECT c_custkey AS c, 's' || c_custkey AS suite FROM customer)"


@register("report_go_tests", f"WITH {_C} SELECT suite, 0::INTEGER AS pos, 'TestA' || c AS test FROM c UNION ALL SELECT suite, 1, 'TestB' FROM c WHERE c % 2 = 0")
def _go_tests(spark, sf_dir):
    text = "concat('package p\\nfunc TestA', c, '(t *testing.T) {\\n}\\nfunc helper(t *testing.T) {}\\n', if(c % 2 = 0, 'func TestB(t *testing.T) {}', ' func TestC(t *testing.T) {}'))"
    return reports.go_tests(_suites(spark, sf_dir).select("suite", F.expr(text).alias("text")))


_RUST = "concat('#[test]\\nfn plain_', c, '() {}\\nfn helper() {}\\n  #[test]\\n  #[should_panic]\\n  pub async fn odd() {}\\n#[test]\\nlet x = 1;\\nfn late() {}\\n', if(c % 3 = 0, '#[derive(A)]\\n#[test]\\nfn third () {', ''))"


@register("report_rust_tests", f"WITH {_C} SELECT suite, 0::INTEGER AS pos, 'plain_' || c AS test FROM c UNION ALL SELECT suite, 1, 'odd' FROM c UNION ALL SELECT suite, 2, 'third' FROM c WHERE c % 3 = 0")
def _rust_tests(spark, sf_dir):
    return reports.rust_tests(_suites(spark, sf_dir).select("suite", F.expr(_RUST).alias("text")))


@register("report_rust_suites", f"WITH {_C} SELECT 'tests/' || suite || '.rs' AS suite, 'integration' AS kind, suite AS target, 2 + (c % 3 = 0)::INTEGER::BIGINT AS tests FROM c WHERE c % 2 = 0 UNION ALL SELECT 'src/' || suite || '.rs', 'lib', suite || '::', 2 + (c % 3 = 0)::INTEGER FROM c WHERE c % 2 = 1")
def _rust_suites(spark, sf_dir):
    """Integration and unit suites with their tests counted; files without tests would not be listed."""
    rows = _suites(spark, sf_dir)
    found = reports.rust_tests(rows.select("suite", F.expr(_RUST).alias("text"))).groupBy("suite").agg(F.count(F.lit(1)).alias("tests"))
    whole = F.col("c") % 2 == 0
    out = rows.join(found, "suite")
    return out.select(
        F.when(whole, F.concat(F.lit("tests/"), "suite", F.lit(".rs"))).otherwise(F.concat(F.lit("src/"), "suite", F.lit(".rs"))).alias("suite"),
        F.when(whole, "integration").otherwise("lib").alias("kind"), F.when(whole, F.col("suite")).otherwise(F.concat("suite", F.lit("::"))).alias("target"), "tests",
    )


@register("report_by_phase", "SELECT (c_custkey % 15) AS phase, string_agg('s' || c_custkey, ',' ORDER BY 's' || c_custkey) AS files FROM customer GROUP BY ALL")
def _by_phase(spark, sf_dir):
    got = reports.by_phase(_suites(spark, sf_dir).select(F.expr("c % 15").alias("phase"), "suite"))
    return got.select("phase", F.array_join("files", ",").alias("files"))


_EVENTS = """WITH e AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'output' WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'fail' ELSE 'pass' END ELSE 'skip' END AS action FROM conversations),
r AS (SELECT 's' || conv_id % 5 AS suite, 't' || conv_id AS test, arg_max(action, turn) FILTER (action IN ('pass', 'fail', 'skip')) AS status, max(turn) FILTER (action IN ('pass', 'fail', 'skip')) AS ended,
  string_agg('line ' || turn, '' ORDER BY turn) FILTER (action = 'output') AS said FROM e GROUP BY ALL)
"""


def _go_results(spark, sf_dir):
    action = "case turn % 4 when 0 then 'run' when 1 then 'output' when 2 then if(conv_id % 3 = 0, 'fail', 'pass') else 'skip' end"
    event = F.expr(f"named_struct('Test', if(turn = 7, '', concat('t', conv_id)), 'Action', {action}, 'Output', concat('line ', turn), 'Elapsed', turn * 0.5D)")
    rows = schema.table(spark, sf_dir, "conversations").select(F.expr("concat('s', conv_id % 5)").alias("suite"), F.col("turn").alias("pos"), F.to_json(event).alias("line"), "conv_id")
    noise = rows.select("suite", (F.col("pos") + 1000).alias("pos"), F.lit("not json").alias("line"))
    expected = rows.select("suite", F.concat(F.lit("t"), F.col("conv_id")).alias("test")).distinct()
    return reports.go_results(expected, reports.go_events(rows.drop("conv_id").union(noise)))


_RESULTS = _EVENTS.replace("FROM conversations)", "FROM conversations WHERE turn <> 7)").replace("r AS (", "n AS (SELECT DISTINCT 's' || conv_id % 5 AS suite, 't' || conv_id AS test FROM conversations), r AS (")
register("report_go_results", _RESULTS + "SELECT suite, test, coalesce(status, 'missing') AS status, ended * 0.5::DOUBLE AS elapsed, CASE WHEN status = 'fail' THEN coalesce(said, '') END AS message FROM n LEFT JOIN r USING (suite, test)")(_go_results)


@register("report_suite_summary", _RESULTS + ", o AS (SELECT suite, coalesce(status, 'missing') AS status FROM n LEFT JOIN r USING (suite, test)) SELECT suite, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status NOT IN ('pass', 'fail')) AS other, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS status FROM o GROUP BY suite")
def _summary(spark, sf_dir):
    return reports.suite_summary(_go_results(spark, sf_dir))


@register("report_rust_results", f"WITH {_C} SELECT suite, 'a' AS test, CASE c % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'skip' END AS status, CASE WHEN c % 3 = 1 THEN 'panicked at ' || c || '\nsecond' END AS message FROM c UNION ALL SELECT suite, 'b', 'pass', NULL FROM c UNION ALL SELECT suite, 'gone', 'missing', NULL FROM c")
def _rust_results(spark, sf_dir):
    text = "concat('running 2 tests\\ntest m::a ... ', element_at(array('ok', 'FAILED', 'ignored'), int(c % 3) + 1), '\\ntest b ... ok\\n\\nfailures:\\n\\n', if(c % 3 = 1, concat('---- m::a stdout ----\\n\\npanicked at ', c, '\\nsecond\\n\\n'), ''), '\\nfailures:\\n    m::a\\n')"
    rows = _suites(spark, sf_dir)
    expected = rows.select("suite", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("gone"))).alias("test"))
    return reports.rust_results(expected, rows.select("suite", F.expr(text).alias("text")))


@register("report_engine_summary", "WITH s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'rust' ELSE 'go' END AS engine, CASE s_suppkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'error' WHEN 2 THEN NULL ELSE 'pass' END AS status FROM supplier UNION ALL SELECT 'none', NULL FROM supplier), a AS (SELECT engine, count(*) AS suites, count(status) AS ran, count(*) FILTER (status = 'pass') AS clean, count(*) FILTER (status IN ('fail', 'error')) AS failing FROM s GROUP BY engine) SELECT *, CASE WHEN ran = 0 THEN suites || ' suites, none run yet' ELSE ran || '/' || suites || ' suites run — ' || clean || ' clean' || CASE WHEN failing > 0 THEN ', ' || failing || ' with failures' ELSE '' END END AS text FROM a")
def _engines(spark, sf_dir):
    s = schema.table(spark, sf_dir, "supplier")
    status = F.expr("case s_suppkey % 5 when 0 then 'fail' when 1 then 'error' when 2 then null else 'pass' end").alias("status")
    rows = s.select(F.expr("if(s_suppkey % 3 = 0, 'rust', 'go')").alias("engine"), status)
    return reports.engine_summary(rows.union(s.select(F.lit("none"), F.lit(None).cast("string"))))


@register("report_benchmark_lines", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS operations, CASE WHEN o_orderkey % 3 > 0 THEN 2 END::BIGINT AS leader_failures, CASE WHEN o_orderkey % 3 > 0 THEN 5 END::BIGINT AS nodes, CASE WHEN o_orderkey % 3 > 0 THEN 25 END::BIGINT AS clients, CASE WHEN o_orderkey % 3 > 0 THEN '1m30.' || o_orderkey || 's' END AS workload, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey / 2 END AS ops_per_sec FROM orders")
def _benchmark(spark, sf_dir):
    said = "concat('x.go:3: RESULT: linearizability verified across ', o_custkey, ' operations under 2 induced leader failures (5-node cluster, 25 concurrent clients, 1m30.', o_orderkey, 's wall-clock, ', string(o_custkey / 2), ' ops/sec)')"
    rows = schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(f"if(o_orderkey % 3 = 0, 'FAIL', {said})").alias("line"))
    return rows.select("id", *reports.benchmark(F.col("line")))


@register("report_highlights", "SELECT o_orderkey AS id, format('{:,}', o_custkey) AS operations, '2 leader failures' AS failures, o_custkey::VARCHAR || ' ops/sec' AS rate FROM orders")
def _highlights(spark, sf_dir):
    """Tiles of a stored benchmark row."""
    rows = schema.table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.format_number("o_custkey", 0).alias("operations"), F.lit("2 leader failures").alias("failures"), F.concat(F.col("o_custkey"), F.lit(" ops/sec")).alias("rate"))


@register("report_log_rows", "SELECT o_orderkey AS idx, o_orderkey <= 500 AS compacted, CASE WHEN o_orderkey <= 500 THEN 'compacted' WHEN o_orderkey <= 900 THEN 'committed' ELSE 'open' END AS state FROM orders")
def _log_rows(spark, sf_dir):
    """Rows of a node's log as a view shows them: compacted up to its offset, committed, or open."""
    at = F.col("idx") <= 500
    rows = schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return rows.select("idx", at.alias("compacted"), F.when(at, "compacted").when(F.col("idx") <= 900, "committed").otherwise("open").alias("state"))
