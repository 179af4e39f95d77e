"""Source files that nobody wrote by hand in their repository.

One scan reads each file once. It gives the hashes of the lines, each together with the two before it, and what rules on
notices and on the composition of the tokens tell: accessors written in pairs, functions that are numbered, lines
without blanks, literals in place of code.

The hashes make an inverted index of repositories. A hash that few repositories hold is rare: its posting names them, and
each file that holds it counts one for each *other* repository there, so the containment of the file in every single
other repository is exact. A hash that more repositories hold is common, tells no repository apart, and counts for all.
A file contained in one other repository to the given share is a copy; edits to a copy lower that by little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.arrays import chunks

CONTAINMENT = 0.8
LEAST_LINES = 5
LINES_TOGETHER = 3
LEAST_CHARS = 40
CHUNK_BYTES = 32_000_000  #: of texts that are read together
RARE = 16  #: repositories that hold a rare hash, at most
ACCESSOR_SHARE = 0.4
NUMBERED = 8
NUMBERED_SHARE = 0.5
LITERAL_SHARE = 0.7
REASONS = ("generated", "vendored", "data", "minified")
LITERAL_CHARS = 300
CODE_LINE_CHARS = 160
BLANK_SHARE = 0.1

#: What a generator says of its output in a leading comment, in several languages.
MARKS = re.compile(
    r"\bcode generated by\b|@generated\b|<auto-?generated\b|\bauto(?:matically)?[- ]?(?:generated|written)\b(?=.*(?:\bby\b|\bdo not\b|\bregenerate\b|\bfrom\b))"
    r"|\bgenerated (?:from|by|with|using)\b(?=.*(?:\bedit\b|\bmodify\b|\bchange|\bregenerate\b|\d))|\bthis (?:file|code) (?:was|is|has been) (?:auto)?(?:matically )?(?:generated|produced|created|written) (?:by|from|with)\b"
    r"|\b(?:local|manual) changes will be (?:lost|overwritten)\b|^\W*do not (?:edit|modify)\b|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:von hand )?(?:bearbeiten|ändern)\b"
    r"|\b(?:produit|généré|créé) (?:automatiquement )?par\b|ne pas modifier|自动生成|请勿(?:手动)?(?:修改|编辑)|generado (?:automáticamente )?por|no (?:editar|modificar)\b",
    re.IGNORECASE,
)
#: Terms under which a notice gives code away, and names of folders for the code of others.
TERMS = re.compile(r"\b(?:released|licen[sc]ed|distributed|available) under\b|\bpermission is hereby granted\b|\bspdx-license-identifier\b|\b(?:apache|mit|bsd|mozilla public|gnu [\w ]*general public) licen[sc]e\b", re.IGNORECASE)
HOLDER = re.compile(r"(?:\(c\)|©|\bcopyright\b)[\s\d,–-]*(?:by |the )*([\w&.\- ]{2,60}?)(?=,|\.|;|\n|$| and contributors| contributors| authors)", re.IGNORECASE)
FOLDERS = re.compile(r"(?:^|/)(?:node_modules|bower_components|third_party|third-party|external|site-packages)/|(?:^|/)vendor/[^/]+/|(?:^|/)deps/[^/]+-\d[\d.]*/", re.IGNORECASE)
OUTPUT_FOLDERS = re.compile(r"(?:^|/)(?:autogen|generated|__generated__|gen)/|_pb2(?:_grpc)?\.py$|\.pb\.go$|\.g\.[cd]?ts$|\.gen\.\w+$|\.generated\.\w+$|Grpc\.java$")
_COMMENT = re.compile(r"\s*(?://|#(?!\[)|/\*|\*|<!--|--|\"\"\"|'''|<\?php\s*$|$)")
_BLOCKS = {"/*": "*/", '"""': '"""', "'''": "'''", "<!--": "-->"}
_SCRIPT_HEAD = re.compile(r"\s*(?:<\?php|package\b|#!|import\b|from\b|namespace\b|use\b|declare\b)")
_FUNCTION = re.compile(
    r"^[ \t]*(?:(?:export|default|async|public|private|protected|static|final|abstract|override|synchronized|def|func|function)\b[ \t]*\*?[ \t]*|\([^()\n]*\)[ \t]*|@\w+[ \t]+)*"
    r"(?:[\w<>\[\], ?.]+[ \t]+)?&?(\w+)[ \t]*(?:<[^<>\n]*>)?\([^;\n]*(?:[{:]|\($|,$)?[ \t]*$|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^\n]*|\w+[ \t]*)(?:=>[ \t]*\{?|\($|,$)?[ \t]*$",
    re.MULTILINE,
)
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "else", "elif", "with", "foreach", "try", "do", "func", "function", "select", "defer", "go", "throw", "await", "match"}
_ACCESSOR = re.compile(r"(get|set)_?(?=[A-Z_\d]|[a-z])(\w+)", re.IGNORECASE)
_LITERAL = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|<<<[ \t]*['\"]?(\w+)['\"]?\r?\n[\s\S]*?\n[ \t]*\1\b|\b\d[\w.]*")
_REMARK = re.compile(r"/\*[\s\S]*?\*/|(?<![:\"'\w])//[^\n]*|^[ \t]*#(?!\[)[^\n]*", re.MULTILINE)
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def leading_comments(text: str) -> list[str]:
    """The comment lines at the top of a file, before its first code besides imports and the like."""
    out, until = [], ""
    for line in text.split("\n"):
        bare = line.strip()
        if until:  # inside a block
            if bare:
                out.append(line)
            until = "" if until in bare else until
        elif _COMMENT.match(line):
            if bare:
                out.append(line)
            mark = next((m for m in _BLOCKS if bare.startswith(m)), "")
            if mark and _BLOCKS[mark] not in bare[len(mark) :]:
                until = _BLOCKS[mark]
        elif not _SCRIPT_HEAD.match(line):
            break
    return out


def function_names(text: str) -> list[str]:
    return [n for a, b in _FUNCTION.findall(text) if (n := a or b) not in _NO_NAMES]


def accessor_pairs(names: list[str]) -> int:
    """How many of these functions come as getter and setter of one thing."""
    kinds: dict[str, set[str]] = {}
    for name in names:
        if found := _ACCESSOR.fullmatch(name):
            kinds.setdefault(found[2].strip("_").lower(), set()).add(found[1].lower())
    return sum(1 for n in names if (found := _ACCESSOR.fullmatch(n)) and len(kinds[found[2].strip("_").lower()]) == 2)


def numbered(names: list[str]) -> int:
    """The size of the largest family of functions of which the names differ in one number of three digits or more only."""
    families: dict[str, set[str]] = {}
    for name in names:
        for found in re.finditer(r"\d{3,}", name):
            families.setdefault(f"{name[: found.start()]}#{name[found.end() :]}", set()).add(found.group())
    return max(map(len, families.values()), default=0)


def _solid(text: str) -> int:
    """Characters that are no white space."""
    return sum(map(len, text.split()))


def reasons_of(path: str, text: str, owner: str) -> list[str]:
    """What the notices and the composition of one file tell: ``generated``, ``minified``, ``data`` or ``vendored``."""
    out = []
    head = leading_comments(text)
    names = function_names(text)
    paired, family = accessor_pairs(names), numbered(names)
    written_out = (paired >= 2 and paired >= ACCESSOR_SHARE * len(names)) or (family >= NUMBERED and family >= NUMBERED_SHARE * len(names))
    if any(MARKS.search(line) for line in head) or written_out or (paired and OUTPUT_FOLDERS.search(path)):
        out.append("generated")
    if FOLDERS.search(path):
        out.append("vendored")
    else:
        notice = "\n".join(head)
        if TERMS.search(notice) and (holder := HOLDER.search(notice)):
            first = re.sub(r"\W", "", holder[1].split()[0].lower()) if holder[1].split() else ""
            if not first or not owner.lower().startswith(first[:5]):
                out.append("vendored")
    code = _REMARK.sub("", text)
    solid = _solid(text)
    literals = sum(_solid(m.group()) for m in _LITERAL.finditer(code))
    if solid and literals >= LITERAL_CHARS and literals >= LITERAL_SHARE * _solid(code) and literals >= 0.5 * solid:
        out.append("data")
    bare = _QUOTED.sub('""', code)
    lines = [line for line in bare.split("\n") if line.strip()]
    if lines and "data" not in out:
        blanks = bare.count(" ") + bare.count("\t")
        if len(bare) >= CODE_LINE_CHARS * len(lines) and blanks <= BLANK_SHARE * len(bare):
            out.append("minified")
    return out


def line_hashes(text: str) -> set[int]:
    """The hash of each line together with those before it, blank ones and margins left out."""
    lines = [line for raw in text.split("\n") if (line := raw.strip())]
    out = set()
    for k in range(len(lines) - LINES_TOGETHER + 1):
        run = "\n".join(lines[k : k + LINES_TOGETHER])
        if len(run) >= LEAST_CHARS:
            out.add(xxhash.xxh3_64_intdigest(run.encode()) - (1 << 63))
    return out


#: Kinds of rows: a line of a file; a line that only stands for others; a common line of a file; a file, its lines and reasons.
_LINE, _WITNESS, _COMMON, _FILE = 0, 1, 2, 3
_TAGGED = "key long, repository long, id long, kind int, number int"


def _read(rare: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in chunks(batch, 3, CHUNK_BYTES)):
            files, lines = [], []
            for key, repository, path, text in zip(*(part.column(k).to_pylist() for k in range(4))):
                reasons = sum(1 << REASONS.index(r) for r in set(reasons_of(path or "", text, (repository or "").split("/")[0])))
                hashes = np.fromiter(line_hashes(text), np.int64)
                files.append((key, reasons, len(hashes)))
                lines.append((hashes, key, xxhash.xxh3_64_intdigest((repository or "").encode()) - (1 << 63)))
            if not files:
                continue
            hashes = np.concatenate([h for h, _, _ in lines])
            ids = np.concatenate([np.full(len(h), key, np.int64) for h, key, _ in lines])
            repositories = np.concatenate([np.full(len(h), r, np.int64) for h, _, r in lines])
            kinds = np.zeros(len(hashes), np.int32)
            # what is common within this chunk is settled here; one line of each of a few repositories tells the others
            order = np.lexsort((repositories, hashes))
            h, r = hashes[order], repositories[order]
            new_hash = np.ones(len(h), bool)
            new_hash[1:] = h[1:] != h[:-1]
            new_repository = new_hash.copy()
            new_repository[1:] |= r[1:] != r[:-1]
            group = np.cumsum(new_hash) - 1
            common = np.bincount(group, weights=new_repository)[group] > rare if len(h) else np.zeros(0, bool)
            rank = np.cumsum(new_repository)
            rank = rank - rank[np.flatnonzero(new_hash)][group] if len(h) else rank
            kinds[order[common & new_repository & (rank <= rare)]] = _WITNESS
            kept = np.ones(len(h), bool)
            kept[order[common]] = kinds[order[common]] == _WITNESS
            settled, lines_of = ids[order[common]], h[common]
            keys, reasons, sizes = (np.array(x, np.int64) for x in zip(*files))
            spread = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            columns = [
                np.concatenate([hashes[kept], spread(settled ^ lines_of), spread(keys)]),
                np.concatenate([repositories[kept], lines_of, reasons]),
                np.concatenate([ids[kept], settled, keys]),
                np.concatenate([kinds[kept], np.full(len(settled), _COMMON, np.int32), np.full(len(keys), _FILE, np.int32)]),
                np.concatenate([np.zeros(kept.sum() + len(settled), np.int32), sizes.astype(np.int32)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "repository", "id", "kind", "number"])

    return read


_COUNTED = "id long, partner long, common boolean, lines int, reasons int"


def _postings(rare: int):
    """Of rows sorted by hash and repository, one for each rare line of a file and each other repository that holds it, and one for each common line.

    Of a hash, what is held are the rows of its first ``rare`` repositories; once there are more, it is common and its
    rows go straight through.
    """

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        open_key, repositories, held, is_common = None, [], [], False
        last = None

        def put(key: int, partner, common, lines, reasons) -> None:
            for column, value in zip(out, (key, partner, common, lines, reasons)):
                column.append(value)

        def close() -> None:
            if not is_common and len(repositories) > 1:
                for repository, key in held:
                    for other in repositories:
                        if other != repository:
                            put(key, other, False, None, None)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "partner", "common", "lines", "reasons"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for key, repository, file, kind, number in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if kind == _FILE:
                    put(file, None, None, number, repository)
                elif kind == _COMMON:
                    put(file, repository, True, None, None)
                else:
                    if key != open_key:
                        close()
                        open_key, repositories, held, is_common, last = key, [], [], False, None
                    if not repositories or repository != repositories[-1]:
                        if not is_common:
                            repositories.append(repository)
                        if len(repositories) > rare and not is_common:
                            is_common = True
                            for _, earlier in held:
                                put(earlier, key, True, None, None)
                            held = []
                    if kind == _WITNESS or (repository, file) == last:
                        continue
                    last = (repository, file)
                    if is_common:
                        put(file, key, True, None, None)
                    else:
                        held.append(last)
            if len(out[0]) > 50_000:
                yield flush()
        close()
        yield flush()

    return postings


def containment(df: DataFrame, key: str, repository: str, path: str, content: str, rare: int = RARE) -> DataFrame:
    """One row a file: ``key``, its ``reasons`` by rule as bits, its hashed ``lines``, and how many of these one other repository ``holds`` at most."""
    files = df.select(df[key].cast("long").alias("id"), df[repository].cast("string").alias("repository"), df[path].cast("string").alias("path"), df[content].cast("string").alias("content")).where("id is not null and content is not null")
    tagged = files.mapInArrow(_read(rare), _TAGGED)
    counted = tagged.repartition("key").sortWithinPartitions("key", "repository", "id").mapInArrow(_postings(rare), _COUNTED)
    by_partner = counted.repartition("id").groupBy("id", "partner", "common").agg(F.count(F.lit(1)).alias("held"), F.max("lines").alias("lines"), F.max("reasons").alias("reasons"))
    rare_ones, common_ones = F.max(F.when(~F.col("common"), F.col("held"))), F.count(F.when(F.col("common"), 1))
    by_file = by_partner.groupBy("id").agg(F.max("reasons").alias("reasons"), F.max("lines").alias("lines"), (F.coalesce(rare_ones, F.lit(0)) + common_ones).alias("holds"))
    return by_file.withColumnRenamed("id", key)


def unwritten_files(df: DataFrame, key: str, repository: str, path: str, content: str, least: float = CONTAINMENT, rare: int = RARE) -> DataFrame:
    """``key`` and ``reason`` of each file that is generated, minified, vendored or data; a file may have several reasons.

    ``copied`` is the reason of the index: one other repository holds the share ``least`` of the file's hashed lines.

    Defined cases: ``key`` is a whole number; rows that repeat it are one file. Null keys and null content are
    left out; a null path or repository tells nothing. Empty files, and files of fewer than ``LEAST_LINES``
    hashed lines, are no copies. Copies count as such wherever the original stands, if it stands in one of the
    repositories at all. A line that several files of one repository hold is no evidence. Files are read whole and
    once. Other columns are never read.
    """
    files = containment(df, key, repository, path, content, rare)
    names = F.array(*(F.when(F.col("reasons").bitwiseAND(1 << k) > 0, F.lit(r)) for k, r in enumerate(REASONS)), F.when((F.col("lines") >= LEAST_LINES) & (F.col("holds") >= least * F.col("lines")), F.lit("copied")))
    return files.select(key, F.explode(F.array_compact(names)).alias("reason"))
