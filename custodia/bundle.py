"""The analysis of all projects as one bundle of DataFrames, and the documents drawn from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custodia.plans import catalog, overviews
from custodia.render import documents
from custodia.rules.structure import RULES, Rule

#: Parts of an analysis and the queries that give them.
PARTS = {
    "inventory": "scanned_inventory", "languages": "language_histogram", "frameworks": "framework_score", "modules": "module_scan", "generic_modules": "generic_modules", "commits": "commit_summary", "authors": "author_details", "files": "author_profile", "risks": "risk_levels",
    "symbols": "declared_symbols", "imports": "import_lines", "edges": "type_edges", "manifests": "manifest_counts", "commands": "project_commands", "prompts": "project_prompts",
}


def analyze(spark: SparkSession, folder: str, parts: list[str] | None = None) -> dict[str, DataFrame]:
    """The named parts, by default all. Nothing runs before a part is used."""
    queries = catalog.queries()
    return {name: queries[PARTS[name]](spark, folder) for name in parts or PARTS}


def render(spark: SparkSession, folder: str, target: str, ending: str = ".md", personal: bool = False) -> None:
    """Writes the documents of all projects, or of all their authors, to ``target``."""
    if personal:
        keys, lines = ["repo_id", "author"], overviews.full_personal_lines(spark, folder)
    else:
        keys, lines = ["repo_id"], overviews.project_report_lines(spark, folder)
    documents.written(documents.markdown(lines, keys), keys, target, ending)


def register_language(language: str, rules: list[tuple[str, str]]) -> None:
    """Adds a language to those of which declarations are read: kinds with patterns of a line. A language that is known keeps its first rules."""
    if not any(r.language == language for r in RULES):
        RULES.extend(Rule(language, kind, pattern) for kind, pattern in rules)


def register_query(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Adds a query to the registered ones; a name that is taken is refused."""
    if name in catalog.ALL:
        raise ValueError(f"{name} is registered")
    catalog.ALL[name] = (query, sql)
