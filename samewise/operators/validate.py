"""Checks of id-list files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Examples named for each issue.
EXAMPLES = 5
HEADERS = {"matched_entity_ids": ["source1_entity_id", "matched_entity_ids"], "candidate_entity_ids": ["source1_entity_id", "candidate_entity_ids"]}


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``line, s1, ids, has_tab``: rows of a list file, cut at the first tab; ids are not trimmed.

    White space behind the tab is an empty list; a trailing comma leaves an empty id. Blank lines are left out.
    """
    v = F.col(value)
    at = F.instr(v, "\t")
    rest = F.substr(v, at + 1)
    ids = F.when(F.trim(F.regexp_replace(rest, r"\s", " ")) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",", -1))
    rows = lines.withColumns({"has_tab": at > 0, "s1": F.when(at > 0, F.substr(v, F.lit(1), at - 1)).otherwise(v), "ids": F.when(at > 0, ids)})
    return rows.where(F.col("has_tab") | (F.trim(F.regexp_replace(v, r"\s", " ")) != ""))


def _issue(df: DataFrame, name: str, item: Column) -> DataFrame:
    """``issue, n, examples``: how many distinct offenders, and the first few; no row if there is none."""
    d = df.select(item.cast("string").alias("x")).distinct()
    # the smallest few are picked by a top-k sort; the counts join them on the issue's name
    few = d.orderBy("x").limit(EXAMPLES).agg(F.lit(name).alias("issue"), F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    return d.agg(F.lit(name).alias("issue"), F.count("*").alias("n")).where("n > 0").join(few, "issue").select("issue", "n", "examples")


def list_issues(parsed: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """``issue, n, examples`` of the errors in a parsed list file.

    ``required`` has ``id`` of the entities that need a row; ``valid`` of the ids a list may have, or is None to skip
    that check. Of repeated rows the last counts for nothing here but the repetition.
    """
    rows = parsed.where("has_tab")
    items = rows.select("s1", F.explode("ids").alias("id"))
    twice = rows.groupBy("s1").agg(F.count("*").alias("k")).where("k > 1")
    checks = [
        _issue(parsed.where(~F.col("has_tab")), "malformed_row", F.col("s1")),
        _issue(twice, "duplicate_row", F.col("s1")),
        _issue(rows.where(F.size("ids") > F.size(F.array_distinct("ids"))), "repeated_id", F.col("s1")),
        _issue(items.where(F.col("id").startswith("S1-")), "self_match", F.col("id")),
        _issue(items.where(~F.col("id").startswith("S1-") & ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")), "wrong_prefix", F.col("id")),
        _issue(required.select("id").distinct().join(rows.select(F.col("s1").alias("id")), "id", "left_anti"), "missing_row", F.col("id")),
        _issue(rows.select(F.col("s1").alias("id")).distinct().join(required.select("id"), "id", "left_anti"), "extra_row", F.col("id")),
    ]
    if valid is not None:
        pool_ids = items.where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")).select("id").distinct()
        checks.append(_issue(pool_ids.join(valid.select("id"), "id", "left_anti"), "unknown_id", F.col("id")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """``issue, n, examples`` of entities with a match that is none of their candidates; a warning only."""
    pairs = lambda p: p.where("has_tab").select("s1", F.explode("ids").alias("id")).distinct()
    return _issue(pairs(matched).join(pairs(candidates), ["s1", "id"], "left_anti"), "outside_candidates", F.col("s1"))


def read_list_file(spark: SparkSession, path: str, column: str) -> tuple[DataFrame | None, list[str]]:
    """The parsed rows of a file and its fatal errors: not there, empty, comma-separated, or another header."""
    try:
        lines = spark.read.text(path)
        head = lines.limit(1).collect()
    except Exception as e:  # noqa: BLE001  the path is not there or can't be read
        return None, [f"file_not_found: {path} ({type(e).__name__})"]
    if not head:
        return None, [f"empty_file: {path}"]
    header = head[0][0]
    if "\t" not in header and "," in header:
        return None, [f"comma_separated: {path}"]
    if [c.strip().lower() for c in header.split("\t")] != HEADERS[column]:
        return None, [f"unexpected_header: {header!r}"]
    numbered = lines.withColumn("n", F.monotonically_increasing_id())
    body = numbered.join(F.broadcast(numbered.agg(F.min("n").alias("n"))), "n", "left_anti")
    return parse_lines(body), []


def validate_outputs(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, valid: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """Errors and warnings of the output files, as text. An output without errors may be handed in."""
    errors, warnings, parsed = [], [], {}
    if valid is None:
        warnings.append("id_check_off: unknown ids were not looked for")
    for path, column in ((matching, "matched_entity_ids"), (candidates, "candidate_entity_ids")):
        if not path:
            continue
        rows, fatal = read_list_file(spark, path, column)
        if fatal and column == "candidate_entity_ids" and fatal[0].startswith("file_not_found"):
            warnings.append(fatal[0])
            continue
        errors += fatal
        if rows is not None:
            parsed[column] = rows
            errors += [f"{column}: {r['issue']} ({r['n']}): {r['examples']}" for r in list_issues(rows, required, valid).collect()]
    if len(parsed) == 2:
        warnings += [f"{r['issue']} ({r['n']}): {r['examples']}" for r in outside_candidates(*parsed.values()).collect()]
    return errors, warnings
