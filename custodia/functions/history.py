"""Column functions on histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The status of each letter.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}


def author_key(value: Column) -> Column:
    """A name or address without blanks and brackets around it, in lower case."""
    return F.lower(F.regexp_replace(F.trim(value), "^<|>$", ""))


def status_of(code: Column) -> Column:
    out = F.lit("other")
    for letter, status in STATUS.items():
        out = F.when(F.substring(code, 1, 1) == letter, F.lit(status)).otherwise(out)
    return out


def merged_status(held: Column, following: Column) -> Column:
    """The status after one more change; depends on the order."""
    return (
        F.when(held == following, held)
        .when(held == "other", following)
        .when(following == "deleted", F.lit("deleted"))
        .when((held == "renamed") | (following == "renamed"), F.lit("renamed"))
        .when((following == "added") & (held == "modified"), F.lit("added"))
        .otherwise(held)
    )


def folded_status(statuses: Column) -> Column:
    return F.aggregate(statuses, F.lit("other"), merged_status)


def stat_path(path: Column) -> Column:
    """The new path of a rename as line statistics print it: ``pre{a => b}post`` or ``a => b``; one side may be empty."""
    braced = F.regexp_replace(F.regexp_replace(path, r"^(.*)\{(.*) => (.*)\}(.*)$", "$1$3$4"), "//+", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braced).otherwise(F.regexp_replace(path, "^.* => ", ""))


def risk_points(changes: Column, lines: Column, deleted: Column, renamed: Column, critical: Column) -> Column:
    """How many of the reasons for a risk hold: many changes, many lines, deleted, renamed, a critical path."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return yes(changes >= 8) + yes(lines >= 500) + yes(deleted) + yes(renamed) + yes(critical)


def risk_reasons(changes: Column, lines: Column, deleted: Column, renamed: Column, critical: Column) -> Column:
    """The reasons for a risk that hold, as codes in order."""
    tests = [("many_changes", changes >= 8), ("many_lines", lines >= 500), ("deleted", deleted), ("renamed", renamed), ("critical_path", critical)]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in tests)))


def risk_level(points: Column, changes: Column, lines: Column) -> Column:
    high = (points >= 3) | (changes >= 12) | (lines >= 1000)
    medium = (points >= 1) | (changes >= 5) | (lines >= 300)
    return F.when(F.coalesce(high, F.lit(False)), "high").when(F.coalesce(medium, F.lit(False)), "medium").otherwise("low")


def risk_weight(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def is_author(target: str, name: Column, email: Column) -> Column:
    """Whether a commit is by ``target``: an address, ``Name <address>``, or a name or address; case does not matter."""
    wanted = target.strip().lower()
    if not wanted:
        return F.lit(False)
    if "<" in wanted and wanted.endswith(">") and not wanted.startswith("<"):
        return author_key(email) == wanted[wanted.rindex("<") + 1 : -1].strip()
    wanted = wanted.strip("<>")
    by_mail = author_key(email) == wanted
    return F.coalesce(by_mail if "@" in wanted else by_mail | (author_key(name) == wanted), F.lit(False))
