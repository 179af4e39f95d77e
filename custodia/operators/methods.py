"""Methods of source files: what they are called with, what is said of them, and what their bodies do.

One pass over each file finds the methods by the patterns of its language and cuts out their bodies; what bodies do is told
by column functions. Texts are not shuffled, only the rows of methods are made distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.functions.bodies import body_from
from custodia.functions.paths import business_area, category
from custodia.functions.text import BODY_NOTES, body_notes, line_of, method_intent, parameter_names, snippets

# How methods look in each language. Groups: doc, visibility where the language has one, name, parameters.
PHP = r"(?:(/\*\*[\s\S]*?\*/)\s*)?(public|protected|private)\s+(?:static\s+)?function\s+(\w+)\s*\(([^)]*)\)"
GO = r"(?:(//[^\n]*\n|/\*[\s\S]*?\*/)\s*)?func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)"
JAVA = r"(?:(/\*\*[\s\S]*?\*/)\s*)?(?:(public|protected|private)\s+)?(?:static\s+)?(?:final\s+)?(?:[\w<>\[\],.?]+\s+)+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:throws\s+[^{]+)?\{"
SCRIPT = [
    r"(?:(/\*\*[\s\S]*?\*/)\s*)?(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)",
    r"(?:(/\*\*[\s\S]*?\*/)\s*)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>",
    r"(?:(/\*\*[\s\S]*?\*/)\s*)?(?:public|private|protected)?\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*\{",
]
_NO_METHODS = {"if", "for", "while", "switch", "catch", "function", "return"}
_PATTERNS = {
    ".php": [re.compile(PHP, re.ASCII)], ".go": [re.compile(GO, re.ASCII)], ".java": [re.compile(JAVA, re.ASCII)], ".kt": [re.compile(JAVA, re.ASCII)],
    **{e: [re.compile(p, re.ASCII) for p in SCRIPT] for e in (".ts", ".tsx", ".js", ".jsx", ".vue")},
}


def included(name: str, extension: str) -> bool:
    if extension == ".php":
        return not name.startswith("__") or name == "__construct"
    return not name.startswith("__") and name not in _NO_METHODS and not (extension == ".go" and name == "init")


def first_sentence(doc: str | None) -> str | None:
    """The first line of a comment that says something, without marks; tag lines do not count."""
    for line in (doc or "").split("\n"):
        bare = re.sub(r"\*/\s*$", "", re.sub(r"^\s*/?\*+\s?", "", re.sub(r"^\s*/{2,}\s?", "", line))).strip()
        if bare and not bare.startswith("@"):
            return bare
    return None


def methods_of(path: str, text: str) -> list[tuple]:
    """Ordinal, name, visibility, parameters, doc and body of each method, by pattern and place; equal name and parameters count once."""
    extension = path[path.rfind(".") :].lower() if "." in path else ""
    out, seen = [], set()
    for pattern in _PATTERNS.get(extension, []):
        for found in pattern.finditer(text):
            groups = found.groups()
            doc, name, raw = groups[0], groups[-2], groups[-1]
            if not included(name, extension):
                continue
            if extension == ".go":
                seen_from = "exported" if name[0].isupper() else "package"
            elif len(groups) == 4:
                seen_from = groups[1] or "package"
            else:
                seen_from = "exported" if "export" in text[max(0, found.start() - 20) : found.end()] else "local"
            params = " ".join(raw.split())
            params = f"{params[:100]}..." if len(params) > 100 else params
            if (name, params) not in seen:
                seen.add((name, params))
                out.append((len(out), name, seen_from, raw, params, first_sentence(doc), body_from(text, found.end() - found.group().endswith("{"))))
    return out


_LAYOUT = "file_id long, repo_id string, file_path string, ordinal int, name string, visibility string, raw string, params string, doc string, body string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 6]
    names = [x.split()[0] for x in _LAYOUT.split(", ")]
    for batch in batches:
        rows = [(key, repo, path, *m) for key, repo, path, text in zip(*(batch.column(k).to_pylist() for k in range(4))) if path and text for m in methods_of(path, text)]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def methods(files: DataFrame, most: int | None = None) -> DataFrame:
    """The methods of each file, at most ``most`` of one. Repeated deliveries count once."""
    found = files.select(F.col("file_id").cast("long"), "repo_id", "file_path", "content").mapInArrow(_found, _LAYOUT)
    return (found if most is None else found.where(F.col("ordinal") < most)).dropDuplicates(["file_id", "ordinal"])


def method_facts(found: DataFrame) -> DataFrame:
    """Intent, parameter names, counts of branches and early exits, conditions and notes of each method."""
    body = F.col("body")
    notes = body_notes(body)
    return found.withColumns({
        "intent": method_intent(F.col("name"), F.col("file_path")), "parameter_names": parameter_names(F.col("raw")), "branches": F.regexp_count(body, F.lit(BODY_NOTES["branching"])), "exits": F.regexp_count(body, F.lit(r"\b(return|throw|continue|break)\b")),
        "conditions": snippets(F.regexp_extract_all(body, F.lit(r"\bif\s*\(([^)]{1,160})\)"), 1), 3), "notes": notes, "body_chars": F.length(body),
    })


#: Words in a file by which it is noted, in order.
FILE_NOTES = [
    ("transaction", ["DB::transaction", "beginTransaction"]), ("cache", ["Redis", "Cache::", "cache.", "localStorage"]), ("spreadsheet", ["Excel", "PHPExcel", "Maatwebsite"]), ("queue", ["Queue", "dispatch(", "go func", "chan "]),
    ("http", ["curl", "Http::", "Guzzle", "fetch(", "axios", "RestTemplate"]), ("data_access", ["select ", "insert ", "update ", "delete ", "gorm.", "DB::"]), ("open_tasks", ["TODO", "FIXME"]),
]


def file_facts(files: DataFrame) -> DataFrame:
    """Namespace, first type and its base, command, table, fields and relations of each file, and notes on it; null where a file has none."""
    text, path = F.col("content"), F.col("file_path")
    first = lambda p, g=1: F.nullif(F.trim(F.regexp_extract(text, p, g)), F.lit(""))
    php = F.lower(path).endswith(".php")
    typed = r"\b(?:class|trait|interface)\s+(\w+)(?:\s+extends\s+([\w\\]+))?"
    notes = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(code)) for code, words in FILE_NOTES]
    notes.append(F.when(category(path).isin("controller", "page", "api"), F.lit("entry_point")))
    fields = F.regexp_extract(text, r"protected\s+\$fillable\s*=\s*\[([\s\S]*?)\]", 1)
    return files.where(text.isNotNull()).select(
        "file_id", category(path).alias("category"), business_area(path).alias("area"), F.when(php, first(r"namespace\s+([^;]+);")).alias("namespace"), F.when(php, first(typed)).otherwise(first(r"\b(?:class|struct|interface|type)\s+([A-Za-z_]\w*)")).alias("class_name"),
        F.when(php, first(typed, 2)).alias("extends"), F.when(php, first(r"protected\s+\$signature\s*=\s*['\"`]([^'\"`]+)['\"`]")).alias("command"), F.when(php, first(r"protected\s+\$table\s*=\s*['\"`]([^'\"`]+)['\"`]")).alias("table_name"),
        F.when(php, F.array_join(F.slice(F.regexp_extract_all(fields, F.lit(r"['\"`]([^'\"`]+)['\"`]"), 1), 1, 12), ",")).alias("fields"), F.array_join(F.array_compact(F.array(*notes)), ",").alias("notes"), line_of(text).alias("first_line"),
    ).dropDuplicates(["file_id"])
