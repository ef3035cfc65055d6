"""Reading of test sources, test output and benchmark lines, as column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns of the texts that are read.
GO_TEST = r"(?m)^func (Test\w+)\(t \*testing\.T\)"
RUST_FN = r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\("
RUST_RESULT = r"(?m)^test (\S+) \.\.\. (ok|FAILED|ignored)\s*$"
RUST_OUTPUT = r"(?s)---- (\S+) stdout ----\n(.*?)(?=\n----|\nfailures:|\z)"
BENCHMARK = (
    r"RESULT: linearizability verified across (\d+) operations under (\d+) induced leader failures "
    r"\((\d+)-node cluster, (\d+) concurrent clients, (.+?) wall-clock, ([\d.]+) ops/sec\)"
)
STATUS = {"ok": "pass", "FAILED": "fail", "ignored": "skip"}


def go_tests(files: DataFrame) -> DataFrame:
    """suite, pos, test of Go test files (suite, text)."""
    return files.select("suite", F.posexplode(F.regexp_extract_all("text", F.lit(GO_TEST), F.lit(1))).alias("pos", "test"))


def rust_tests(files: DataFrame) -> DataFrame:
    """suite, pos, test: functions after a test attribute, other attributes between them allowed.

    A line is what follows ``#[test]`` if of the lines that are no attributes the one before it, or it is the first, had a
    test attribute after it; the window is one file's lines.
    """
    lines = files.select("suite", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    marked, attribute = F.col("text") == "#[test]", F.col("text").startswith("#[")
    order = Window.partitionBy("suite").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lines.withColumns({"mark": F.max(F.when(marked, F.col("line"))).over(order), "plain": F.max(F.when(~attribute, F.col("line"))).over(order)})
    hit = last.where(~attribute & (F.col("mark") > F.coalesce("plain", F.lit(-1))))
    found = hit.withColumn("test", F.regexp_extract("text", RUST_FN, 1)).where("test <> ''")
    place = F.row_number().over(Window.partitionBy("suite").orderBy("line")) - 1
    return found.select("suite", place.alias("pos"), "test")


def by_phase(suites: DataFrame) -> DataFrame:
    """phase, files (in order) of suites (phase, suite): a phase has a bounded number of files."""
    return suites.groupBy("phase").agg(F.sort_array(F.collect_list("suite")).alias("files"))


def go_events(lines: DataFrame) -> DataFrame:
    """suite, pos, test, action, output, elapsed of JSON event lines (suite, pos, line); other lines and package events go."""
    event = F.from_json("line", "Test string, Action string, Output string, Elapsed double")
    rows = lines.select("suite", "pos", event.alias("e")).where("e.Test is not null and e.Test <> ''")
    return rows.select("suite", "pos", F.col("e.Test").alias("test"), F.col("e.Action").alias("action"), F.col("e.Output").alias("output"), F.col("e.Elapsed").alias("elapsed"))


def go_results(expected: DataFrame, events: DataFrame) -> DataFrame:
    """suite, test, status, elapsed, message of each expected test: its last pass, fail or skip; the output of those that fail."""
    ended = F.col("action").isin("pass", "fail", "skip")
    at = F.when(ended, F.col("pos"))
    parts = F.sort_array(F.collect_list(F.when(F.col("action") == "output", F.struct("pos", "output"))))  # one test's output
    found = events.groupBy("suite", "test").agg(F.max_by("action", at).alias("status"), F.max_by("elapsed", at).alias("elapsed"), parts.alias("parts"))
    rows = expected.join(found, ["suite", "test"], "left")
    status = F.coalesce("status", F.lit("missing"))
    message = F.when(F.col("status") == "fail", F.array_join(F.transform("parts", lambda p: p["output"]), ""))
    return rows.select("suite", "test", status.alias("status"), "elapsed", message.alias("message"))


def rust_results(expected: DataFrame, outputs: DataFrame) -> DataFrame:
    """suite, test, status, message of each expected test in cargo output (suite, text), by name or by the end of a path."""
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("said"))
    bare = F.element_at(F.split("p.name", "::"), -1)
    listed = outputs.select("suite", F.explode(pairs(RUST_RESULT)).alias("p")).select("suite", bare.alias("test"), F.col("p.said").alias("word"))
    said = outputs.select("suite", F.explode(pairs(RUST_OUTPUT)).alias("p")).select("suite", bare.alias("test"), F.trim(F.regexp_replace("p.said", r"^\s+|\s+$", "")).alias("message"))
    word = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    rows = expected.join(listed.groupBy("suite", "test").agg(F.first("word").alias("word")), ["suite", "test"], "left")
    rows = rows.join(said.groupBy("suite", "test").agg(F.first("message").alias("message")), ["suite", "test"], "left")
    status = F.when(F.col("word").isNull(), "missing").otherwise(word[F.col("word")])
    return rows.select("suite", "test", status.alias("status"), F.when(F.col("word") == "FAILED", F.col("message")).alias("message"))


def suite_summary(results: DataFrame) -> DataFrame:
    """suite, passed, failed, other, status: a suite fails if any of its tests does."""
    passed, failed = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    out = results.groupBy("suite").agg(passed.alias("passed"), failed.alias("failed"), F.count(F.lit(1)).alias("all"))
    return out.select("suite", "passed", "failed", F.expr("all - passed - failed").alias("other"), F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"))


def engine_summary(suites: DataFrame) -> DataFrame:
    """engine, suites, ran, clean, failing, text of suites (engine, status; null for those not run)."""
    out = suites.groupBy("engine").agg(
        F.count(F.lit(1)).alias("suites"), F.count_if(F.col("status").isin("pass", "fail", "error")).alias("ran"),
        F.count_if(F.col("status") == "pass").alias("clean"), F.count_if(F.col("status").isin("fail", "error")).alias("failing"),
    )
    bad = F.when(F.col("failing") > 0, F.concat(F.lit(", "), "failing", F.lit(" with failures"))).otherwise("")
    line = F.concat("ran", F.lit("/"), "suites", F.lit(" suites run — "), "clean", F.lit(" clean"), bad)
    return out.withColumn("text", F.when(F.col("ran") == 0, F.concat("suites", F.lit(" suites, none run yet"))).otherwise(line))


def benchmark(line: Column) -> list[Column]:
    """operations, leader_failures, nodes, clients, workload, ops_per_sec of a result line; null where there is none."""
    kinds = [("operations", "long"), ("leader_failures", "long"), ("nodes", "long"), ("clients", "long"), ("workload", "string"), ("ops_per_sec", "double")]
    return [F.nullif(F.regexp_extract(line, BENCHMARK, i + 1), F.lit("")).cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)]
