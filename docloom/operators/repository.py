"""Repository analytics over files as rows: references, markers, versions, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import file_version

# A contract reference, and the sections that a complete contract has.
REFERENCE = r"CONTRACT:([A-Z]+[0-9]*-[A-Z0-9-]+(?:[.][0-9]+){0,2})"
REQUIRED_SECTIONS = ("## Interfaces", "## Behavioral", "## Error", "## Test", "## Implementing")


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, text)."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def references(lines: DataFrame, pattern: str = REFERENCE) -> DataFrame:
    """(path, line, name) of every reference."""
    return lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))


def broken_references(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("name").distinct(), "name", "left_anti")


def zombies_and_shadows(specified: DataFrame, implemented: DataFrame) -> DataFrame:
    """(name, state): specified without code, or code without a specification; one join of both sides."""
    s, i = specified.select("name").distinct().withColumn("s", F.lit(True)), implemented.select("name").distinct().withColumn("i", F.lit(True))
    state = F.when(F.col("i").isNull(), "zombie").when(F.col("s").isNull(), "shadow")
    return s.join(i, "name", "full_outer").select("name", state.alias("state")).where("state IS NOT NULL")


def link_targets(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, target): relative links to what is neither a file nor a folder with files."""
    raw = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s#]+)[^)]*\)"), F.lit(1))).alias("raw")).where("NOT raw RLIKE '^[a-z]+:'")
    base = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    steps = F.concat(base, F.filter(F.split("raw", "/"), lambda s: (s != "") & (s != ".")))
    up = lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s)))
    wanted = raw.withColumn("target", F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("target"))
    return wanted.join(folders.distinct(), "target", "left_anti").select("path", "line", "target")


def missing_headers(lines: DataFrame, marker: str, within: int = 15) -> DataFrame:
    """Files whose first lines lack a marker."""
    return lines.groupBy("path").agg(F.bool_or((F.col("line") <= within) & F.contains("text", F.lit(marker))).alias("has")).where("NOT has").select("path")


def section_completeness(lines: DataFrame, required: tuple[str, ...] = REQUIRED_SECTIONS) -> DataFrame:
    """(path, n_sections, complete): how many required headings a file has."""
    hit = F.filter(F.array(*[F.when(F.startswith("text", F.lit(r)), F.lit(r)) for r in required]), lambda x: x.isNotNull())
    each = lines.select("path", F.explode_outer(hit).alias("h")).groupBy("path").agg(F.count_distinct("h").alias("n_sections"))
    return each.withColumn("complete", F.col("n_sections") == len(required))


def content_by_section(lines: DataFrame) -> DataFrame:
    """(path, heading, n_content): lines that say something under each heading; blank lines and comments do not."""
    head = F.last(F.when(F.col("text").rlike("^## "), F.col("text")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    body = lines.withColumn("heading", head).where("heading IS NOT NULL")
    says = (F.trim("text") != "") & ~F.col("text").rlike(r"^\s*<!--.*-->\s*$") & ~F.col("text").rlike("^## ")
    return body.groupBy("path", "heading").agg(F.count_if(says).alias("n_content"))


def latest_versions(files: DataFrame, name_col: str = "name") -> DataFrame:
    """(id, name): of NAME.major.minor.md, the one with the highest version of each NAME."""
    v = files.withColumn("v", file_version(name_col)).where("v IS NOT NULL")
    return v.groupBy(F.col("v.id").alias("id")).agg(F.max_by(name_col, F.struct("v.major", "v.minor")).alias("name"))


def stale(files: DataFrame, today, days: int, date_col: str = "last_verified") -> DataFrame:
    """Files last verified more than so many days before the given day."""
    return files.withColumn("age", F.date_diff(F.lit(today).cast("date"), F.col(date_col))).where(F.col("age") > days)


def todo_counts(lines: DataFrame, marker: str = r"\b(TODO|FIXME)\b", ticket: str = r"\b(TODO|FIXME)\((#[0-9]+|[A-Z]+-[0-9]+)\)") -> DataFrame:
    """One row: lines with a marker, and how many of them name a ticket."""
    todo = F.col("text").rlike(marker)
    tracked = todo & F.col("text").rlike(ticket)
    return lines.agg(F.count_if(todo).alias("n_todo"), F.count_if(tracked).alias("n_tracked"), F.count_if(todo & ~tracked).alias("n_untracked"))


def contract_counts(files: DataFrame, by: str, draft: Column, owner: str) -> DataFrame:
    """(by, n, n_draft, n_owners): files, drafts and distinct owners of each group."""
    return files.groupBy(by).agg(F.count("*").alias("n"), F.count_if(draft).alias("n_draft"), F.count_distinct(owner).alias("n_owners"))


def prefix_collisions(names: DataFrame, prefix: Column, owner: str) -> DataFrame:
    """(prefix, owners, n): prefixes that several rows share, with their owners in order."""
    owners = F.array_join(F.array_sort(F.collect_set(owner)), ",")
    return names.groupBy(prefix.alias("prefix")).agg(owners.alias("owners"), F.count("*").alias("n")).where("n > 1")


def lifecycle(n_implementing: Column, n_tests: Column, complete: Column) -> Column:
    """draft until the sections are complete, then active, testing with tests, implemented with tests and code."""
    return F.when(~complete, "draft").when((n_implementing > 0) & (n_tests > 0), "implemented").when(n_tests > 0, "testing").otherwise("active")
