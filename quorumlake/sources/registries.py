"""Registries kept as tables in markdown files, and what is wrong with their entries (SRC-09, QLY-05).

A row of a table means what its section and its header say, which stand on
earlier lines. The reader is a table function over the lines of a file in
order, files in parallel: it remembers the section and the header, a new
section ends the header, and rows of another width than their header are left
out, as are the rules between header and body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_rule = re.compile(r":?-+:?")
# The statuses of entries, and with which Current and Authority each may stand.
STATUSES = ("Development", "Frozen", "Superseded", "Historical")
GOVERNANCE = (("Frozen", "YES", "AUTHORITATIVE"), ("Development", "NO", "NON-AUTHORITATIVE"), ("Superseded", "NO", "NON-AUTHORITATIVE"), ("Historical", "NO", "NON-AUTHORITATIVE"))
# The columns that name an entry, in order of preference, and the columns of a dependency matrix.
NAMING = ("Document", "Artifact", "Review Artifact", "Registry Version")
MATRIX = ("Dependent Identifier", "Dependent Version", "Dependency Identifier", "Dependency Version", "Dependency Status", "Relationship", "Semantic Compatibility", "Approval Reference")
# Where an entry's file is linked, and what of a name identifies it.
LOCATION = r"\]\((released/v1\.\d+/[^)]+)\)"
IDENTIFIER = r"[A-Z]+-\d{3}"


@udtf(returnType="file string, line int, section string, cells map<string,string>")
class RegistryRows:
    """(file, line, value), a file's lines in order, to its rows by column name."""

    def __init__(self) -> None:
        self.section: str = ""
        self.header: list[str] = []

    def eval(self, row: object) -> Iterator[tuple]:
        value = row["value"] or ""
        if value.startswith("## "):
            self.section, self.header = value[3:].strip(), []
        elif value.startswith("|"):
            cells = [c.strip() for c in value[1:-1].split("|")]
            if all(_rule.fullmatch(c) for c in cells):
                return
            if not self.header:
                self.header = cells
            elif len(cells) == len(self.header):
                yield row["file"], row["line"], self.section, dict(zip(self.header, cells, strict=True))


def registry_rows(lines: DataFrame) -> DataFrame:
    """file, line, section, cells of every row of the tables in ``lines`` (file, line, value); of columns of one name the last counts."""
    ordered = lines.select("file", F.col("line").cast("int").alias("line"), "value").asTable().partitionBy("file").orderBy("line")
    return RegistryRows(ordered)


def registry_fields(rows: DataFrame) -> DataFrame:
    """file, line, section, field, value."""
    return rows.select("file", "line", "section", F.explode("cells").alias("field", "value"))


def _cell(name: str) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter("cells", lambda k, _: k == name)), F.lit(0)), F.lit(""))


def _first_of(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(_cell(n) != "", _cell(n)) for n in names])


def entries(rows: DataFrame, titles: Sequence[str] = ()) -> DataFrame:
    """file, line, section, name, identifier, version, status, current, authority, location, replacement of the rows of registries.

    ``titles`` identify an entry whose name begins with one, as its number does that of others.
    """
    known = "|".join([IDENTIFIER, *(re.escape(t) for t in titles)])
    located = F.regexp_extract(_cell("Location"), LOCATION, 1)
    name = _first_of(NAMING)
    found = F.regexp_extract(_first_of(NAMING[:3]), f"^({known})", 1)
    return rows.select(
        "file",
        "line",
        "section",
        name.alias("name"),
        F.when(found != "", found).otherwise(_first_of(NAMING[:3])).alias("identifier"),
        _cell("Version").alias("version"),
        _cell("Status").alias("status"),
        _cell("Current").alias("current"),
        _cell("Authority").alias("authority"),
        F.when(located != "", F.replace(located, F.lit("%20"), F.lit(" "))).alias("location"),
        F.regexp_replace(_cell("Superseded By"), r"^[ —]+|[ —]+$", "").alias("replacement"),
    )


def _title(text: Column) -> Column:
    """Each run of letters with a capital first, the others small."""
    return F.initcap(F.lower(text))


def governance_errors(found: DataFrame) -> DataFrame:
    """file, line, name, error: entries that lack something, combine what may not stand together, or have no replacement; and
    identifiers that a registry names as authoritative more than once, with a null line. ``found`` is of ``entries``."""
    status = _title(F.col("status"))
    governed = (F.col("status") != "") & ((F.col("current") != "") | (F.col("authority") != ""))
    lacking = F.col("name").isNull() | (F.col("current") == "") | (F.col("authority") == "")
    valid = _any(status)
    replaced = F.col("location").isNotNull() & (status == "Superseded") & (F.col("replacement") == "")
    error = F.when(governed & lacking, "MISSING_GOVERNANCE").when(governed & ~valid, "INVALID_COMBINATION").when(replaced, "NO_REPLACEMENT")
    rows = found.select("file", "line", "name", error.alias("error")).filter("error IS NOT NULL")
    authoritative = found.filter(F.col("location").isNotNull() & F.col("section").startswith("Authoritative artifacts"))
    twice = authoritative.groupBy("file", "identifier").count().filter("count > 1")
    return rows.unionByName(twice.select("file", F.lit(None).cast("int").alias("line"), F.col("identifier").alias("name"), F.lit("SEVERAL_AUTHORITIES").alias("error")))


def _any(status: Column) -> Column:
    out = F.lit(False)
    for s, current, authority in GOVERNANCE:
        out = out | ((status == s) & (F.col("current") == current) & (F.col("authority") == authority))
    return out


def dependency_errors(matrix: DataFrame, found: DataFrame) -> DataFrame:
    """row, error: the first thing that is wrong with each row of a dependency matrix against the registries' current entries.

    ``matrix`` has row and the columns of ``MATRIX``; an entry that is authoritative more than once counts with its last line.
    """
    authoritative = found.filter(F.col("location").isNotNull() & F.col("section").startswith("Authoritative artifacts"))
    current = authoritative.groupBy("identifier").agg(F.max_by(F.struct("version", "status"), F.struct("file", "line")).alias("entry"))
    side = lambda name, column: current.select(F.col("identifier").alias(column), F.col("entry").alias(name))
    j = matrix.join(side("_a", "Dependent Identifier"), "Dependent Identifier", "left").join(side("_b", "Dependency Identifier"), "Dependency Identifier", "left")
    c = lambda name: F.col(f"`{name}`")
    blank = F.lit(False)
    for name in MATRIX:
        blank = blank | (F.trim(F.coalesce(c(name), F.lit(""))) == "")
    error = (
        F.when(blank, "MISSING_VALUE")
        .when(F.col("_a").isNull(), "DEPENDENT_NOT_CURRENT")
        .when(F.col("_b").isNull(), "DEPENDENCY_NOT_CURRENT")
        .when(c("Dependent Version") != F.col("_a.version"), "DEPENDENT_VERSION")
        .when(c("Dependency Version") != F.col("_b.version"), "DEPENDENCY_VERSION")
        .when((F.col("_a.status") != "FROZEN") | (F.col("_b.status") != "FROZEN") | (c("Dependency Status") != "FROZEN"), "NOT_FROZEN")
        .when(c("Semantic Compatibility") != "Compatible", "NOT_COMPATIBLE")
    )
    return j.select("row", error.alias("error")).filter("error IS NOT NULL")
