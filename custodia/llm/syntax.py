"""Source files that do not parse in the language of their extension.

Files are cut into chunks of lines before anything is read, and runs of chunks are spread over the tasks. Each chunk
becomes a map from the lexer states in which it may begin to the state in which it ends and a summary of its brackets;
what is balanced inside a chunk is parsed there with local grammars. Neighbouring summaries are combined, associatively,
first within a run and then by file; a file is valid if its combined summary ends in code, leaves no bracket open, breaks
no grammar, and its outermost statements parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.arrays import chunks as parts_of
from custodia.llm.lexing import FIRST, LANGUAGES, pieces, states_of
from custodia.llm.summaries import Summary, joined, packed, stands, summarise, unpacked

CHUNK_CHARS = 32_768
RUN_CHUNKS = 64


def parses(language: str, text: str, chunk_chars: int = CHUNK_CHARS) -> bool:
    """The verdict on one text."""
    whole: Summary | None = None
    states = states_of(language, text)
    for chunk in pieces(text, chunk_chars) or [""]:
        summary = summarise(language, chunk, states if whole else [FIRST[language]])
        whole = joined(language, whole, summary) if whole else summary
    return stands(language, whole)


def _cut(chunk_chars: int, run_chunks: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts_of(batch, 2)):
            for key, language, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                chunks = pieces(text, chunk_chars) or [""]
                size = len(chunks)
                states = states_of(language, text)
                columns = [pa.array([key] * size, pa.int64()), pa.array([k // run_chunks for k in range(size)], pa.int32()), pa.array(range(size), pa.int32()), pa.array([language] * size), pa.array([[FIRST[language]]] + [states] * (size - 1), pa.list_(pa.string())), pa.array(chunks, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "run", "n", "language", "states", "text"])

    return cut


def _folded(rows: Iterator[tuple[int, int, int, str, Summary]]) -> Iterator[tuple[int, int, int, str, Summary]]:
    """Neighbours of one file and run combined; rows are sorted, and one that repeats its number counts once."""
    held: tuple | None = None
    for key, run, n, language, summary in rows:
        if held is not None and held[:2] == (key, run):
            if n > held[2]:
                held = (key, run, n, language, joined(language, held[4], summary))
            continue
        if held is not None:
            yield held
        held = (key, run, n, language, summary)
    if held is not None:
        yield held


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        last = None
        for batch in batches:
            for part in parts_of(batch, 5):
                for key, run, n, language, states, text in zip(*(part.column(k).to_pylist() for k in range(6))):
                    if (key, n) != last:
                        yield key, run, n, language, summarise(language, text, states)
                    last = (key, n)

    for key, run, _, language, summary in _folded(rows()):
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([run], pa.int32()), pa.array([language]), pa.array([packed(summary)], pa.binary())], ["id", "run", "language", "summary"])


def _fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, run, language, summary in zip(*(batch.column(k).to_pylist() for k in range(4))):
                yield key, 0, run, language, unpacked(summary)

    for key, _, _, language, summary in _folded(rows()):
        if not stands(language, summary):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64())], ["id"])


def spoken(language: Column) -> Column:
    """The name of a language in the spelling used here, or null if it is none of those read."""
    plain = F.lower(F.trim(language))
    names = {x.lower(): x for x in LANGUAGES} | {"py": "Python", "js": "JavaScript", "ts": "TypeScript", "golang": "Go"}
    out = F.lit(None).cast("string")
    for short, name in names.items():
        out = F.when(plain == short, F.lit(name)).otherwise(out)
    return out


def broken_files(df: DataFrame, key: str, language: str, content: str, chunk_chars: int = CHUNK_CHARS, run_chunks: int = RUN_CHUNKS) -> DataFrame:
    """``key`` of each file whose content is no valid source of its language.

    The text is shuffled once, by file and run of ``run_chunks`` chunks, so that neither a large file nor a large
    block of a table is read by one task; what goes on to the second shuffle, by file, are the combined summaries.

    Defined cases: ``key`` is a whole number; rows that repeat it are one file. Null keys, null content and
    languages other than the six are left out. An empty file, or one of comments only, is valid, but for Go,
    where a package clause is missing. Text outside a script is valid PHP. Files of any length are read whole, and
    the size of chunks and runs changes no verdict. Other columns are never read.
    """
    files = df.select(df[key].cast("long").alias("id"), spoken(df[language]).alias("language"), df[content].cast("string").alias("content")).where("id is not null and language is not null and content is not null")
    chunks = files.mapInArrow(_cut(chunk_chars, run_chunks), "id long, run int, n int, language string, states array<string>, text string")
    runs = chunks.repartition("id", "run").sortWithinPartitions("id", "n").mapInArrow(_summaries, "id long, run int, language string, summary binary")
    found = runs.repartition("id").sortWithinPartitions("id", "run").mapInArrow(_fallen, "id long")
    return found.withColumnRenamed("id", key)


def broken_rates(df: DataFrame, key: str, repository: str, language: str, content: str) -> DataFrame:
    """Files, broken files and their rate for each repository and language; cases as in ``broken_files``."""
    files = df.where(df[key].isNotNull() & df[content].isNotNull()).select(df[key].cast("long").alias(key), df[repository].alias(repository), spoken(df[language]).alias("language")).where("language is not null").distinct()
    broken = broken_files(df, key, language, content).withColumn("broken", F.lit(1))
    counts = files.join(broken, key, "left").groupBy(repository, "language").agg(F.count(F.lit(1)).alias("files"), F.count("broken").alias("broken_files"))
    return counts.withColumn("rate", F.col("broken_files") / F.col("files"))
