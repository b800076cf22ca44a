"""Analytics over file corpora, commit logs and markdown: everything is a table of files or lines."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import lookups, text as X, values as V
from millrace.operators.aggregates import grouped_counts
from millrace.plans.joins import salted_join
from millrace.plans.topn import at_most
from millrace.plans.runs import numbered
from millrace.plans.spread import widen
from millrace.plans.topn import first_per_key

CODE_LANGUAGES = ("python", "javascript", "typescript", "rust", "go", "java")


def split_lines(text: Column) -> Column:
    """Lines of a text; a closing newline does not open another line, and no text has no lines."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\n|\r"))


def describe_files(files: DataFrame) -> DataFrame:
    """File table from (path, content, length, modificationTime): language, category, binary flag, hash, lines."""
    path, raw = F.col("path"), F.col("content")
    binary = F.instr(raw, F.unhex(F.lit("00"))) > 0
    shown = F.try_validate_utf8(raw.cast("string"))
    return files.select(
        path, F.col("length").alias("size_bytes"), lookups.language_of(path).alias("language"), lookups.category_of(path).alias("category"),
        F.coalesce(binary, F.lit(False)).alias("is_binary"), F.sha2(raw, 256).alias("content_hash"),
        F.when(~binary, F.size(split_lines(F.coalesce(shown, F.lit(""))))).otherwise(0).alias("line_count"), F.col("modificationTime").alias("last_modified"),
    )


# Line beginnings that mark a comment.
COMMENT_MARKS = ("#", "//", "/*", "*", '"""', "'''")


def line_metrics(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per file: lines, blank, comment and logical lines, and the comment share in percent."""
    once = F.explode(F.array(F.transform(split_lines(F.col(text)), lambda x: F.btrim(x, F.lit(" \t\r\n\f"))))).alias("ls")
    rows = widen(files.select(key, text), key).select(key, once)

    def is_comment(x: Column) -> Column:
        hit = F.lit(False)
        for mark in COMMENT_MARKS:
            hit = hit | x.startswith(mark)
        return hit

    out = rows.select(
        key, F.size("ls").alias("lines"), F.size(F.filter("ls", lambda x: x == "")).alias("blank"), F.size(F.filter("ls", is_comment)).alias("comments")
    )
    ratio = F.when(F.col("lines") > 0, F.col("comments") * 100.0 / F.col("lines")).otherwise(0.0)
    return out.withColumns({"logical": F.col("lines") - F.col("blank") - F.col("comments"), "comment_ratio": ratio})


# Words and signs that open a branch.
BRANCH_WORDS = ("if", "elif", "while", "for", "and", "or", "except", "with", "case", "lambda")
BRANCH_PATTERN = r"\b(?:" + "|".join(BRANCH_WORDS) + r")\b|\?\s*:"


def branch_complexity(text: Column) -> dict[str, Column]:
    return {
        "complexity": F.regexp_count(text, F.lit(BRANCH_PATTERN)) + 1, "functions": F.regexp_count(text, F.lit(r"\bdef\s+\w+")),
        "classes": F.regexp_count(text, F.lit(r"\bclass\s+\w+")),
    }


# Line beginnings that add nesting, and those that leave it alone.
NESTING_STARTS = ("if ", "elif ", "else:", "for ", "while ", "try:", "except", "with ")
FLAT_STARTS = ("def ", "class ", "return", "pass", "break", "continue")


def nesting_complexity(text: Column) -> Column:
    """Branching lines weighted by the depth at which they stand, a fold over the lines in order."""

    def starts(x: Column, options: Sequence[str]) -> Column:
        hit = F.lit(False)
        for o in options:
            hit = hit | x.startswith(o)
        return hit

    def step(state: Column, line: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t\r\n\f"))
        total, depth = state["total"], state["depth"]
        branch = F.struct((total + 1 + depth).alias("total"), F.when(bare.endswith(":"), depth + 1).otherwise(depth).alias("depth"))
        idle = (bare == "") | bare.startswith("#") | starts(bare, FLAT_STARTS)
        back = F.struct(total.alias("total"), F.greatest(depth - 1, F.lit(0)).alias("depth"))
        return F.when(starts(bare, NESTING_STARTS), branch).when(~idle & (depth > 0) & (F.length(bare) < F.length(line)), back).otherwise(state)

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("depth"))
    return F.aggregate(split_lines(text), start, step, lambda s: s["total"])


def function_lengths(text: Column) -> Column:
    """Line counts of the functions of a text, each up to the next top-level def or class."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(def\s+\w+\s*\([^)]*\)\s*:.*?(?=\ndef|\nclass|\z))"), F.lit(1))
    return F.transform(found, lambda f: F.size(split_lines(f)))


def code_quality(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for a corpus: totals, mean and longest function, maintainability, grade, debt minutes."""
    lines = line_metrics(files, key, text).agg(
        F.sum("lines").alias("lines"), F.sum("logical").alias("logical"), F.sum("comments").alias("comments"), F.sum("blank").alias("blank")
    )
    col = F.col(text)
    per = widen(files.select(key, text), key).select(
        *[c.alias(n) for n, c in branch_complexity(col).items()], nesting_complexity(col).alias("nested"), function_lengths(col).alias("lengths")
    )
    total = per.agg(
        F.count(F.lit(1)).alias("files"), F.sum("complexity").alias("complexity"), F.sum("nested").alias("nested"), F.sum("functions").alias("functions"),
        F.sum("classes").alias("classes"), F.sum(F.aggregate("lengths", F.lit(0), lambda a, b: a + b)).alias("_sum"), F.sum(F.size("lengths")).alias("_n"),
        F.max(F.array_max("lengths")).alias("longest_function"),
    )
    out = total.withColumns({c: lines.select(c).scalar() for c in lines.columns})
    score = V.maintainability(F.col("complexity"), F.col("lines"))
    return out.withColumns({
        "mean_function": F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)), "maintainability": score, "grade": V.letter_grade(score),
        "debt_minutes": F.greatest(F.col("complexity") - F.col("files") * 10, F.lit(0)) * 10,
    }).drop("_sum", "_n")


# Scan rules with their severity.
SCAN_RULES = {
    "hardcoded_secret": (r"""(?i)(password|secret|api[_-]?key|token|private[_-]?key)\s*[=:]\s*["'][^"']{8,}["']""", "high"),
    "sql_injection": (r"""(?i)(execute|cursor\.execute|raw|rawquery)\s*\(\s*["'][^"']*%s""", "high"),
    "shell_injection": (r"(?i)(subprocess\.call|os\.system|os\.popen|shell=True)", "medium"),
    "eval_usage": (r"\beval\s*\(", "medium"),
    "pickle_usage": (r"(?i)pickle\.(load|loads)\s*\(", "medium"),
    "yaml_unsafe": (r"yaml\.(load|unsafe_load)\s*\([^)]*Loader\s*=\s*None", "medium"),
    "debug_enabled": (r"(?i)(debug\s*[=:]\s*true|DEBUG\s*=\s*True)", "low"),
    "http_without_https": (r"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)", "low"),
    "weak_crypto": (r"(?i)(md5|sha1)\s*\(", "low"),
    "temp_file_usage": (r"(?i)/tmp/|tempfile\.mk(?:s)?temp\(", "info"),
}
SCAN_SEVERITIES = ("critical", "high", "medium", "low", "info")


def scan_rules(lines: DataFrame, rules: Mapping[str, tuple[str, str]] | None = None, at_least: str = "info", max_rules: int = 1000) -> DataFrame:
    """Findings (line columns, rule_id, severity, snippet): every rule that matches a line.

    The rules become one array of tests per line, a narrow map over the corpus. ``max_rules`` keeps the
    expression within reason.
    """
    rules = dict(rules or SCAN_RULES)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; split them into runs of at most {max_rules}")
    worst = SCAN_SEVERITIES.index(at_least)
    tests = [
        F.when(F.col("line").rlike(pattern), F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity")))
        for name, (pattern, severity) in rules.items() if SCAN_SEVERITIES.index(severity) <= worst
    ]
    found = lines.withColumn("_e", F.explode(F.array_compact(F.array(*tests))))
    return found.select(*[c for c in lines.columns if c != "line"], "_e.rule_id", "_e.severity", F.substring(F.trim("line"), 1, 200).alias("snippet"))


def worst_findings(found: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SCAN_SEVERITIES]), F.col("severity"))
    return at_most(found.orderBy(rank, *order), limit)


def requirement_rows(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dependencies of requirements files: rows (key, name, version)."""
    lines = files.select(key, F.explode(F.transform(split_lines(F.col(text)), lambda x: F.trim(x))).alias("l"))
    kept = lines.where((F.col("l") != "") & ~F.col("l").startswith("#") & ~F.col("l").startswith("-"))
    pattern = r"^([a-zA-Z0-9_-]+)(?:\[.*\])?([<>=!~]+.*)?$"
    version = F.nullif(F.trim(F.regexp_extract("l", pattern, 2)), F.lit(""))
    return kept.where(F.col("l").rlike(pattern)).select(key, F.regexp_extract("l", pattern, 1).alias("name"), version.alias("version"))


def package_json_rows(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dependencies of package files: rows (key, name, version, is_dev)."""
    doc = F.try_parse_json(F.col(text))
    sections = (("dependencies", False), ("devDependencies", True), ("peerDependencies", False))
    parts = [
        F.transform(
            F.map_entries(F.coalesce(F.try_variant_get(doc, f"$.{name}", "map<string,string>"), F.create_map().cast("map<string,string>"))),
            (lambda dev: lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("is_dev")))(dev),
        )
        for name, dev in sections
    ]
    return files.select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")


def cargo_rows(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dependencies of Cargo manifests: rows (key, name, version, is_dev), section by section."""
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        moved = F.struct(F.lower(bare).alias("section"), state["out"].alias("out"))
        kept = F.struct(state["section"].alias("section"), F.concat(state["out"], F.array(F.struct(state["section"].alias("section"), bare.alias("line")))).alias("out"))
        return F.when(bare.startswith("["), moved).when(state["section"].contains("dependencies") & bare.contains("="), kept).otherwise(state)

    rows = files.select(key, F.explode(F.aggregate(split_lines(F.col(text)), start, step, lambda s: s["out"])).alias("e")).select(key, "e.*")
    value = F.btrim(F.trim(F.regexp_replace("line", r"^[^=]*=", "")), F.lit("\"'"))
    inline = F.nullif(F.regexp_extract(value, r"""version\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    version = F.when(value.startswith("{"), inline).otherwise(value)
    is_dev = F.col("section").rlike("dev[-_]dependencies")
    return rows.select(key, F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)).alias("name"), version.alias("version"), is_dev.alias("is_dev"))


def pyproject_rows(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dependencies of the project table of pyproject files: rows (key, name, version)."""
    block = F.regexp_extract(text, r"(?s)\[project\]\s*.*?dependencies\s*=\s*\[(.*?)\]", 1)
    items = F.transform(split_lines(block), lambda x: F.btrim(F.btrim(F.trim(x), F.lit(",")), F.lit("\"'")))
    rows = files.select(key, F.explode(items).alias("l")).where("l <> ''")
    pattern = r"^([a-zA-Z0-9_-]+)(?:\[.*\])?(.*)$"
    version = F.nullif(F.trim(F.regexp_extract("l", pattern, 2)), F.lit(""))
    return rows.where(F.col("l").rlike(pattern)).select(key, F.regexp_extract("l", pattern, 1).alias("name"), version.alias("version"))


# License texts, first match wins.
LICENSES = (
    ("MIT", r"MIT License|Permission is hereby granted.*MIT"), ("Apache-2.0", r"Apache License.*Version 2\.0|apache-2\.0"),
    ("GPL-3.0", r"GNU GENERAL PUBLIC LICENSE.*Version 3|GPL-3\.0"), ("GPL-2.0", r"GNU GENERAL PUBLIC LICENSE.*Version 2|GPL-2\.0"),
    ("BSD-3-Clause", r"BSD 3-Clause|Redistribution and use.*three conditions"), ("BSD-2-Clause", r"BSD 2-Clause|Simplified BSD"),
    ("ISC", r"ISC License|ISC LICENSE"), ("MPL-2.0", r"Mozilla Public License.*2\.0"),
    ("LGPL-3.0", r"GNU LESSER GENERAL PUBLIC LICENSE.*Version 3"), ("Unlicense", r"This is free and unencumbered software|UNLICENSE"),
)


def license_of(text: Column) -> Column:
    chain = F
    for name, pattern in LICENSES:
        chain = chain.when(text.rlike(f"(?i){pattern}"), name)
    return chain.otherwise(F.lit(None))


# Capital words that are no environment variables.
NOT_VARIABLES = ("TRUE", "FALSE", "NULL", "NONE", "TODO", "FIXME", "NOTE")


def environment_names(files: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """Sorted distinct names in capitals, three characters or more."""
    # \w follows Unicode at word borders, as names next to accented letters are no names.
    pattern = r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9_]{2,})(?![\p{L}\p{N}_])"
    found = files.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("name")).distinct()
    return at_most(found.where(~F.col("name").isin(*NOT_VARIABLES)).orderBy("name"), limit)


def documentation_score(files: DataFrame, path: str = "path", text: str = "text", sample: int | None = None) -> DataFrame:
    """One row: 0 to 100 from readme, docs folder, comments in the code files (all, or the first ``sample``), changelog and the like."""
    p, name = F.col(path), F.upper(lookups.file_name(F.col(path)))
    has = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    flags = files.agg(
        has(p.isin("README.md", "readme.md", "README.MD", "README", "README.rst", "README.txt")).alias("readme"),
        has(p.contains("docs/") | p.contains("documentation/")).alias("docs"),
        has(name.isin("CHANGELOG.MD", "CHANGELOG", "CHANGES.MD", "HISTORY.MD")).alias("changelog"), has(name.contains("CONTRIBUTING")).alias("contributing"),
        has(F.lower(p).contains("api") & (lookups.language_of(p) == "markdown")).alias("api"), has(p.contains("examples/") | p.contains("example/")).alias("examples"),
    )
    code = files.where(lookups.language_of(p).isin(*CODE_LANGUAGES))
    commented = (code if sample is None else code.orderBy(path).limit(sample)).agg(F.coalesce(F.avg(F.col(text).rlike(r"""(#|//|/\*|\"\"\"|''')""").cast("double")), F.lit(0.0)).alias("s")).scalar()
    score = F.col("readme") * 20 + F.col("docs") * 15 + commented * 25 + 10 * (F.col("changelog") + F.col("contributing") + F.col("api") + F.col("examples"))
    return flags.select(F.least(score, F.lit(100.0)).alias("score"))


def find_by_name(files: DataFrame, pattern: str, path: str = "path", limit: int | None = None) -> DataFrame:
    return at_most(files.where(lookups.file_name(F.col(path)).rlike(pattern)).orderBy(path), limit)


# --- commits ------------------------------------------------------------------------------------------


def parse_commits(log: DataFrame, line: str = "line") -> DataFrame:
    """Commit table from ``sha|short|name|email|iso time|message`` lines; short lines drop out.

    ``local`` is the time on the author's clock, ``at`` the instant.
    """
    parts = F.split(line, r"\|", 6)
    rows = log.select(parts.alias("p")).where(F.size("p") == 6)
    iso = F.regexp_replace(F.col("p")[4], "Z$", "+00:00")
    return rows.select(
        F.col("p")[0].alias("sha"), F.col("p")[1].alias("short_sha"), F.col("p")[2].alias("author"), F.lower(F.col("p")[3]).alias("email"),
        F.try_to_timestamp(iso).alias("at"), F.substring(iso, 1, 19).try_cast("timestamp_ntz").alias("local"), F.col("p")[5].alias("message"),
    )


def commit_cuts(commits: DataFrame) -> DataFrame:
    """Commits per day, hour, weekday (Monday 0) and month with author, by the author's own clock: rows (cut, key, n)."""
    t = F.col("local")
    return grouped_counts(commits, {
        "day": F.date_format(t, "yyyy-MM-dd"), "hour": F.hour(t), "weekday": F.weekday(t), "month_author": F.concat_ws(" ", F.date_format(t, "yyyy-MM"), "email"),
    })


def contributors(commits: DataFrame) -> DataFrame:
    """Per e-mail: name of the newest commit, commits, first and last commit."""
    return commits.groupBy("email").agg(
        F.max_by("author", F.struct("at", "sha")).alias("name"), F.count(F.lit(1)).alias("commits"), F.min("at").alias("first_commit"), F.max("at").alias("last_commit")
    )


def parse_numstat(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows (path, insertions, deletions, binary) from tab-separated counts; a dash means binary and counts 0."""
    parts = F.split(line, "\t")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 3) & F.col("p")[0].rlike(r"^(\d+|-)$"))
    count = lambda i: F.coalesce(F.col("p")[i].try_cast("bigint"), F.lit(0))
    return rows.select(F.col("p")[2].alias("path"), count(0).alias("insertions"), count(1).alias("deletions"), (F.col("p")[0] == "-").alias("binary"))


def change_totals(numstat: DataFrame) -> DataFrame:
    return numstat.agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("changes"))


def most_changed(numstat: DataFrame, limit: int | None = None) -> DataFrame:
    return at_most(numstat.groupBy("path").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.desc("changes"), "path"), limit)


def change_set(numstat: DataFrame, status: DataFrame) -> DataFrame:
    """Counts and status of every changed path; a path with counts only is modified, one with a status only has none."""
    counted = numstat.groupBy("path").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.max("binary").alias("binary"))
    out = counted.join(status.select("path", F.substring("status", 1, 1).alias("status"), "old_path"), "path", "full")
    return out.select(
        "path", F.coalesce("status", F.lit("M")).alias("status"), F.when(F.col("status") == "R", F.col("old_path")).alias("old_path"),
        F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), F.coalesce("binary", F.lit(False)).alias("binary"),
    )


# --- markdown -----------------------------------------------------------------------------------------

FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
# Reference targets and the patterns that declare them; group 1 is the label.
TARGET_PATTERNS = {
    "section": r"(?im)\(([a-z0-9_-]+)\)=\s*\n+#{1,6}\s+.+$", "figure": r"(?s)```\{figure\}\s*\S+.*?:name:\s*(\S+)",
    "equation": r"(?si)\$\$\s*\n.+?\n\s*\$\$\s*\(([a-z0-9_-]+)\)", "code": r"(?s)```\{code-(?:block|cell)\}.*?:name:\s*(\S+)",
}


def front_matter(text: Column) -> Column:
    """Flat keys of the front matter as a map; nested values are not read."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    pairs = F.filter(F.transform(split_lines(block), lambda l: F.struct(
        F.regexp_extract(l, r"^([A-Za-z0-9_-]+):\s", 1).alias("key"), F.btrim(F.regexp_extract(l, r"^[A-Za-z0-9_-]+:\s+(.*?)\s*$", 1), F.lit("\"'")).alias("value"))), lambda p: p["key"] != "")
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(firsts)


def parse_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per page: title, front matter, heading count, directives, citations, references, labels, block equations."""
    source = F.col(text)
    body = F.regexp_replace(source, FRONT_MATTER, "")
    found = lambda pattern, group=1: F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
    matter = front_matter(source)
    first = F.regexp_extract(body, r"(?m)^(#{1,6})\s+(.+)$", 1)
    heading = F.when(first == "#", F.trim(F.regexp_extract(body, r"(?m)^(#{1,6})\s+(.+)$", 2)))
    return docs.select(
        key, F.coalesce(F.try_element_at(matter, F.lit("title")), heading).alias("title"), matter.alias("front_matter"),
        F.size(found(r"(?m)^(#{1,6})\s+(.+)$")).alias("sections"), F.transform(found(r"```\{([\w-]+)\}"), lambda d: F.lower(d)).alias("directives"),
        found(r"\{cite\}`([^`]+)`").alias("citations"), F.concat(found(r"\{ref\}`([^`]+)`"), found(r"\(([a-z0-9_-]+)\)=")).alias("references"),
        F.size(found(r"(?s)\$\$(.*?)\$\$")).alias("equations"),
    )


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, line_no, level, title, anchor) of all headings."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_i", "l")).where(F.col("l").rlike(r"^#{1,6}\s+.+$"))
    title = F.trim(F.regexp_extract("l", r"^#{1,6}\s+(.+)$", 1))
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), F.length(F.regexp_extract("l", r"^(#{1,6})\s", 1)).alias("level"), title.alias("title"), X.ascii_slug(title).alias("anchor"))


def reference_targets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, type, number, label); figures, equations and code blocks are numbered within their file."""
    parts = []
    for kind, pattern in TARGET_PATTERNS.items():
        labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        parts.append(_numbered_labels(labels, kind))
    return docs.select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")


def _numbered_labels(labels: Column, kind: str) -> Column:
    number = lambda i: F.lit(None).cast("int") if kind == "section" else (i + 1).cast("int")
    return F.transform(labels, lambda l, i: F.struct(F.lit(kind).alias("type"), number(i).alias("number"), l.alias("label")))


def reference_statistics(targets: DataFrame) -> DataFrame:
    return targets.groupBy("type").agg(F.count(F.lit(1)).alias("targets"), F.count_distinct("label").alias("labels"))


def mentions(docs: DataFrame, key: str, role: str, text: str = "text") -> DataFrame:
    """Rows (key, position, mark, display, ref) of ``{role}`` marks, with the ``display <ref>`` form taken apart."""
    marks = F.regexp_extract_all(text, F.lit(r"\{%s\}`([^`]+)`" % role), F.lit(1))
    rows = docs.select(key, F.posexplode(marks).alias("position", "mark"))
    pattern = r"^([^<]+)<([^>]+)>"
    custom = F.col("mark").rlike(pattern)
    return rows.select(
        key, "position", "mark", F.when(custom, F.trim(F.regexp_extract("mark", pattern, 1))).otherwise(F.col("mark")).alias("display"),
        F.when(custom, F.trim(F.regexp_extract("mark", pattern, 2))).otherwise(F.col("mark")).alias("ref"),
    )


def resolve_text(docs: DataFrame, resolved: DataFrame, key: str, role: str, text: str = "text") -> DataFrame:
    """Texts with their role marks replaced; ``resolved`` gives (key, position, shown) per mark.

    The text between marks is kept piece by piece and joined with the replacements; what one document
    gathers is its own marks.
    """
    pieces = F.split(text, r"\{%s\}`[^`]+`" % role, -1)
    swaps = resolved.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "shown"))), lambda s: s["shown"]).alias("_s"))
    out = docs.join(swaps, key, "left").withColumn("_p", pieces)
    woven = F.array_join(F.transform("_p", lambda p, i: F.concat(p, F.coalesce(F.get("_s", i), F.lit("")))), "")
    return out.withColumn(text, F.when(F.col("_s").isNull(), F.col(text)).otherwise(woven)).drop("_s", "_p")


def resolve_terms(found: DataFrame, glossary: DataFrame, key: str) -> DataFrame:
    """Glossary marks as links; a term that is not in the glossary is shown in italics. Adds ``known``."""
    known = glossary.select(F.lower("term").alias("_t"), "definition")
    known = first_per_key(known, ["_t"], ["definition"])
    joined = salted_join(found.withColumn("_t", F.lower("ref")), known, ["_t"], [key, "position"], "left")
    link = F.concat(F.lit("["), "display", F.lit("](#glossary-"), F.lower("ref"), F.lit(")"))
    shown = F.when(F.col("definition").isNotNull(), link).otherwise(F.concat(F.lit("*"), "display", F.lit("*")))
    return joined.withColumns({"shown": shown, "known": F.col("definition").isNotNull()}).drop("_t")


def merge_reference_tables(local: DataFrame, remote: DataFrame, key: str = "label") -> DataFrame:
    """Reference tables together; the remote entry wins where both declare a label."""
    both = local.withColumn("_o", F.lit(0)).unionByName(remote.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], ["_o"], latest=True).drop("_o")


def parse_bibtex(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Citation rows (key, cite_key, type, title, authors, year, journal, doi, url) from BibTeX text."""
    pattern = r"(?s)@(\w+)\s*\{\s*([^,]+)\s*,([^@]+)\}"
    whole = F.regexp_extract_all(text, F.lit(r"(?s)(@\w+\s*\{\s*[^,]+\s*,[^@]+\})"), F.lit(1))
    rows = docs.select(key, F.explode(whole).alias("e"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("e", r'(?is)\b%s\s*=\s*[{"]([^}"]+)[}"]' % name, 1), F.lit(""))

    authors = F.transform(F.split(field("author"), " and "), lambda a: F.trim(a))
    return rows.select(
        key, F.trim(F.regexp_extract("e", pattern, 2)).alias("cite_key"), F.lower(F.regexp_extract("e", pattern, 1)).alias("type"),
        F.coalesce(field("title"), F.lit("Untitled")).alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        field("year").try_cast("int").alias("year"), field("journal").alias("journal"), field("doi").alias("doi"), field("url").alias("url"),
    )


def citation_text(style: str = "apa") -> Column:
    """Text of a citation row in a short APA or Chicago form."""
    authors = F.col("authors")
    if style == "chicago":
        return F.concat(F.array_join(authors, ", "), F.lit('. "'), "title", F.lit('." '), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("."))
    names = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))
    year = F.coalesce(F.concat(F.lit("("), F.col("year").cast("string"), F.lit(")")), F.lit("(n.d.)"))
    base = F.concat(names, F.lit(" "), year, F.lit(". "), "title", F.lit("."))
    in_journal = (F.col("type") == "article") & F.col("journal").isNotNull()
    return F.when(in_journal, F.concat(base, F.lit(" *"), "journal", F.lit("*."))).otherwise(base)


# Languages whose files are searched for framework words.
FRAMEWORK_LANGUAGES = ("python", "javascript", "typescript", "rust", "go")


def corpus_summary(files: DataFrame, path: str = "path", text: str = "text", size: str = "size_bytes") -> DataFrame:
    """One row: files, bytes, languages, primary language, frameworks, build and CI systems, license."""
    p = F.col(path)
    language = lookups.language_of(p)
    by_name = lookups.indicators_in(lookups.file_name(p), lookups.FRAMEWORK_WORDS)
    by_text = F.when(language.isin(*FRAMEWORK_LANGUAGES), lookups.indicators_in(F.col(text), lookups.FRAMEWORK_WORDS))
    facts = files.select(
        language.alias("language"), F.col(size).alias("size"), lookups.build_systems(p).alias("build"), lookups.ci_systems(p).alias("ci"),
        F.array_union(by_name, F.coalesce(by_text, F.array().cast("array<string>"))).alias("frameworks"),
        F.when(F.upper(lookups.file_name(p)).isin("LICENSE", "LICENSE.TXT", "LICENSE.MD", "COPYING"), license_of(F.col(text))).alias("license"), p.alias("path"),
    )

    def names(column: str, known: Mapping[str, Sequence[str]]) -> Column:
        """The known names that any file shows: one flag each, so that nothing is collected."""
        return F.array_join(F.array_compact(F.array(*[F.when(F.bool_or(F.array_contains(column, n)), F.lit(n)) for n in sorted(known)])), ",")

    per_language = facts.where("language <> 'unknown'").groupBy("language").agg(F.sum("size").alias("b"))
    primary = per_language.agg(F.min_by("language", F.struct(-F.col("b"), F.col("language"))).alias("l")).scalar()
    return facts.agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct(F.when(F.col("language") != "unknown", F.col("language"))).alias("languages"),
        names("frameworks", lookups.FRAMEWORK_WORDS).alias("frameworks"), names("build", lookups.BUILD_SYSTEM_FILES).alias("build_systems"),
        names("ci", lookups.CI_FRAGMENTS).alias("ci_systems"),
        F.min_by("license", F.when(F.col("license").isNotNull(), F.col("path"))).alias("license"),
    ).withColumn("primary_language", primary)
