"""Functions paired with their documentation.

Comment spans and function spans are taken from the files independently of each other. An as-of join by
file attaches to each function the nearest comment before it (in Python the nearest string after its head);
both carry the number of tokens before them, which differs if a statement stands between, so such pairs are
rejected. What is left of a comment without marks, tags and parameter sections then decides.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.arrays import chunks
from custodia.llm.lexing import FIRST, Token, scan
from custodia.llm.summaries import tokens_stand
from custodia.llm.syntax import spoken

LEAST_WORDS = 5
LEAST_HAN = 10

#: Words that head a statement though brackets follow, modifiers of a declaration, words that say nothing by themselves.
_HEADS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "synchronized", "try", "do", "else", "with", "function", "foreach", "elseif", "match", "fn", "use", "declare", "await", "typeof", "super", "this", "yield", "assert", "array", "list", "isset", "unset", "empty", "echo", "print", "func", "select", "go", "defer", "range", "case", "void", "delete", "in", "of", "instanceof"}
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "async", "get", "set", "readonly", "override", "export", "default", "declare", "synchronized", "native", "strictfp", "accessor", "var"}
_FUNCTION_WORDS = set(
    "a an the this that these those it its is are was be been being has have had do does did will would can could should shall may might must to of for from in on at by with and or but not no as if then than so into onto over under method function procedure constructor class helper given all any each every our your their we you i".split()
)
_REMARKS = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|to be (?:written|documented|done)|(?:please )?(?:document|describe|write) (?:this|me)\b|待(?:补充|写|办)|noch zu (?:schreiben|dokumentieren)|à (?:rédiger|documenter))|\bauto(?:matically)?[- ]?generated\b|\bgenerated (?:by|from|method|stub)\b|自动生成|automatisch (?:erzeugt|generiert)",
    re.IGNORECASE,
)
_SECTION = re.compile(r"^(\s*)(?:args|arguments|parameters|params|keyword args(?:uments)?|other parameters|returns?|yields?|raises|throws|attributes)\s*:?\s*$", re.IGNORECASE)
_TAG = re.compile(r"^\s*(?:@\w+|:\w[\w ]*(?:\s+[^:]*)?:)")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


def description(text: str, language: str) -> str:
    """``text`` without comment marks, tag lines and parameter sections."""
    if language == "Python":
        lines = text.split("\n")
    else:
        body = re.sub(r"^\s*/\*+|\*+/\s*$", "", text) if text.lstrip().startswith("/*") else text
        lines = [re.sub(r"^\s*(?:\*+(?!/)|//+) ?", "", line) for line in body.split("\n")]
        if language == "Go":
            lines = [a for a, b in zip(lines, body.split("\n")) if not re.match(r"\s*//(?:go:|nolint|line |export |\s*\+build)", b)]
    out: list[str] = []
    margin: int | None = None  # of the section or tag that is being left out
    for line in lines:
        wide = len(line) - len(line.lstrip())
        if margin is not None:
            if not line.strip() or wide > margin or re.fullmatch(r"\s*-{3,}\s*", line):
                continue
            margin = None
        if (found := _SECTION.match(line)) and language == "Python":
            margin = len(found[1])
            continue
        if _TAG.match(line):
            margin = wide
            continue
        out.append(re.sub(r"\{@\w+\s*([^{}]*)\}", r"\1", line))
    return "\n".join(out).strip()


def name_parts(name: str) -> set[str]:
    return {p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


def _stems(word: str) -> set[str]:
    return {word, word.removesuffix("s"), word.removesuffix("es"), word.removesuffix("ed"), word.removesuffix("d"), word.removesuffix("ing"), word.removesuffix("ing") + "e", re.sub(r"ies$", "y", word)}


def trivial(text: str, name: str) -> bool:
    """Whether a description says nothing that the name does not say."""
    lines = [line for line in text.split("\n") if not _REMARKS.search(line)]
    rest = " ".join(lines)
    words = [w.lower() for w in _WORD.findall(_HAN.sub(" ", rest))]
    if len(words) < LEAST_WORDS and len(_HAN.findall(rest)) < LEAST_HAN:
        return True
    if len(_HAN.findall(rest)) >= LEAST_HAN:
        return False
    parts = name_parts(name)
    own = parts | {name.lower()}
    return all(w in _FUNCTION_WORDS or _stems(w) & own or any(p in own for p in w.split("-")) for w in words)


class Function:
    __slots__ = ("name", "at", "head", "place", "line", "params")

    def __init__(self, name: str, at: int, head: int, place: int, line: int, params: list[str]):
        self.name, self.at, self.head, self.place, self.line, self.params = name, at, head, place, line, params


def _matching(tokens: list[Token]) -> dict[int, int]:
    stack, out = [], {}
    for k, token in enumerate(tokens):
        if token.kind == "(":
            stack.append(k)
        elif token.kind == ")" and stack:
            a = stack.pop()
            out[a], out[k] = k, a
    return out


def _params(tokens: list[Token], start: int, stop: int, match: dict[int, int], language: str) -> list[str]:
    """The names between two round brackets."""
    out, part, k, angle = [], [], start + 1, 0
    while k <= stop:
        token = tokens[k]
        angle += (token.text == "<") - (token.text == ">")
        if k == stop or (token.text == "," and angle <= 0):
            words = [t.text for t in part if t.kind == "w"]
            if words:
                if language == "Java":
                    out.append(words[-1])
                elif language == "PHP":
                    out.extend([w for w in words if w.startswith("$")][:1])
                else:
                    plain = [w for w in words if w not in _MODIFIERS] or words
                    out.append(plain[0])
            part, angle = [], 0
        elif token.kind == "(":
            k = match[k]
        elif token.text == "=" and part:  # the default is no name
            part.append(Token("o", "=", token.at, False))
        elif not any(t.text == "=" for t in part):
            part.append(token)
        k += 1
    return out


def _body_after(tokens: list[Token], k: int, match: dict[int, int], language: str) -> bool:
    """Whether a body follows the parameters that end at ``k``, behind a type, a throws clause or captured names."""
    k += 1
    first = k
    while k < len(tokens):
        token = tokens[k]
        if token.text == "{":
            before = tokens[k - 1].text
            if before in (":", "|", "&", "<", ",") and language == "TypeScript":  # a type in braces
                k = match[k] + 1
                continue
            if language == "Go" and before in ("struct", "interface"):
                k = first = match[k] + 1
                continue
            return True
        if token.text in (";", "}", ")", "]", "=", "=>") or (token.fresh and language == "Go" and k == first):
            return False
        if token.kind == "(":
            k = match[k]
        k += 1
    return False


def _backwards(tokens: list[Token], k: int, match: dict[int, int], language: str) -> int:
    """The first token of the declaration whose last modifier or name is ``k``."""
    while k > 0:
        before = tokens[k - 1]
        if before.text == "*" and language in ("JavaScript", "TypeScript") and k > 1 and tokens[k - 2].text in ("async", "static", ";", "{", "}"):
            k -= 1
        elif before.kind == "w" and before.text.lower() in _MODIFIERS:
            k -= 1
        elif before.kind == ")" and before.text == ")" and (a := match.get(k - 1)) and tokens[a - 1].kind == "w" and _annotated(tokens, a - 1):
            k = _annotated(tokens, a - 1) - 1
        elif before.kind == "w" and _annotated(tokens, k - 1):
            k = _annotated(tokens, k - 1) - 1
        elif before.text == "]" and language == "PHP" and (a := match.get(k - 1)) and tokens[a - 1].text == "#":
            k = a - 1
        else:
            break
    return k


def _annotated(tokens: list[Token], k: int) -> int:
    """One more than the place of the @ before the dotted name that ends at ``k``; 0 if there is none."""
    while k >= 2 and tokens[k - 1].text == "." and tokens[k - 2].kind == "w":
        k -= 2
    return k if k >= 1 and tokens[k - 1].text == "@" else 0


def _java_head(tokens: list[Token], k: int, match: dict[int, int]) -> int:
    while k > 0 and tokens[k - 1].text not in (";", "{", "}"):
        k -= 1
        if tokens[k].kind == ")" and k in match:
            k = match[k]
    return k


def functions_of(language: str, text: str, tokens: list[Token], lines: list[int]) -> list[Function]:
    """The named functions with a body. ``lines`` are the places at which lines begin."""
    match = _matching(tokens)
    out: list[Function] = []
    kinds: dict[int, str] = {}  # of each open brace
    opened: list[int] = []
    size = len(tokens)

    def line_of(k: int) -> int:
        return bisect.bisect_right(lines, tokens[k].at)

    def add(name: int, head: int, first: int) -> None:
        out.append(Function(tokens[name].text, tokens[head].at, head, name, line_of(name), _params(tokens, first, match[first], match, language)))

    heading = ""  # what the tokens since the last ; { } announce
    for k, token in enumerate(tokens):
        if token.kind == "(":
            if token.text in ("{", "${"):
                before = tokens[k - 1].text if k else ""
                kinds[k] = "class" if heading == "class" and before != "=>" else "object" if before in ("=", "(", ",", ":", "return", "[", "?", "=>", "??", "||") and not (before == "=>") else "block"
                heading = ""
            opened.append(k)
            continue
        if token.kind == ")":
            if opened:
                opened.pop()
            if token.text == "}":
                heading = ""
            continue
        if token.text == ";":
            heading = ""
        around = kinds.get(opened[-1], "") if opened else ""
        follows = tokens[k + 1].text if k + 1 < size else ""
        before = tokens[k - 1].text if k else ""
        if token.kind != "w":
            continue
        word = token.text
        if word in ("class", "interface", "trait", "enum") and before not in (".", "::", "->"):
            heading = "class"
        if language == "Java" and word == "record" and tokens[min(k + 1, size - 1)].kind == "w":
            heading = "class"
        if language == "Go":
            if word == "func" and not opened:
                n = k + 1
                if follows == "(":
                    n = match[k + 1] + 1
                if n < size and tokens[n].kind == "w":
                    first = n + 1
                    if first < size and tokens[first].text == "[":
                        first = match[first] + 1
                    if first < size and tokens[first].text == "(" and _body_after(tokens, match[first], match, language):
                        add(n, k, first)
            continue
        if language == "PHP":
            if word.lower() == "function":
                n = k + 1 + (follows == "&")
                if n + 1 < size and tokens[n].kind == "w" and tokens[n + 1].text == "(" and _body_after(tokens, match[n + 1], match, language):
                    add(n, _backwards(tokens, k, match, language), n + 1)
            continue
        if language == "Java":
            if follows == "(" and word not in _HEADS and before not in (".", "new", "@", "=", "return", "(", ",", "->") and around == "class" and _body_after(tokens, match[k + 1], match, language):
                head = _java_head(tokens, k, match)
                if not any(t.text in ("=", "new", "class") for t in tokens[head:k]):
                    add(k, head, k + 1)
            continue
        # JavaScript and TypeScript
        if word == "function" and before != ".":
            n = k + 1 + (follows == "*")
            if n < size and tokens[n].kind == "w":
                first = _past_types(tokens, n + 1, match)
                if first < size and tokens[first].text == "(" and _body_after(tokens, match[first], match, language):
                    add(n, _backwards(tokens, k, match, language), first)
            continue
        if word in ("const", "let", "var") and before not in (".",) and k + 1 < size and tokens[k + 1].kind == "w":
            n = k + 1
            equals = n + 1
            while equals < size and tokens[equals].text not in ("=", ";", ",", ")", "of", "in") and not (tokens[equals].fresh and equals > n + 1 and tokens[equals].kind == "w"):
                equals = match[equals] + 1 if tokens[equals].kind == "(" else equals + 1
            if equals < size and tokens[equals].text == "=" and (first := _bound(tokens, equals + 1, match)):
                _add_bound(tokens, first, match, add, n, _backwards(tokens, k, match, language), out, line_of)
            continue
        if around in ("class", "object") and before not in (".", "function", "new"):
            starts = before in ("{", "}", ";", ",", "*") or tokens[k].fresh or before in _MODIFIERS or before.startswith("@") or tokens[k - 1].text in (")", "]")
            if not starts:
                continue
            first = _past_types(tokens, k + 1, match)
            if first < size and tokens[first].text == "(" and word not in _HEADS - {"delete", "with", "in", "of", "match", "list", "empty", "print", "go", "select", "use", "array", "range"} and _body_after(tokens, match[first], match, language):
                add(k, _backwards(tokens, k, match, language), first)
            elif around == "object" and follows == ":" and (first := _bound(tokens, k + 2, match)):
                _add_bound(tokens, first, match, add, k, k, out, line_of)
            elif around == "class" and word not in _MODIFIERS:
                equals = k + 1
                while equals < size and tokens[equals].text not in ("=", ";", "}", ")") and not (tokens[equals].fresh and equals > k + 1):
                    equals = match[equals] + 1 if tokens[equals].kind == "(" else equals + 1
                if equals < size and tokens[equals].text == "=" and (first := _bound(tokens, equals + 1, match)):
                    _add_bound(tokens, first, match, add, k, _backwards(tokens, k, match, language), out, line_of)
    return out


def _past_types(tokens: list[Token], k: int, match: dict[int, int]) -> int:
    """The place after type parameters in angle brackets, if there are any at ``k``."""
    if k < len(tokens) and tokens[k].text == "?":
        k += 1
    if k < len(tokens) and tokens[k].text == "<":
        depth = 0
        while k < len(tokens):
            depth += (tokens[k].text == "<") - (tokens[k].text == ">")
            if tokens[k].text in (";", "{"):
                return k
            k += 1
            if depth == 0:
                break
    return k


def _bound(tokens: list[Token], k: int, match: dict[int, int]) -> int:
    """The place of the parameters if an arrow function or a function expression begins at ``k``, else 0."""
    size = len(tokens)
    if k < size and tokens[k].text == "async" and k + 1 < size and (tokens[k + 1].text in ("(", "function", "<") or tokens[k + 1].kind == "w"):
        k += 1
    if k < size and tokens[k].text == "function":
        k += 1
        k += k < size and tokens[k].text == "*"
        k += k < size and tokens[k].kind == "w"
        return k if k < size and tokens[k].text == "(" else 0
    k = _past_types(tokens, k, match)
    if k < size and tokens[k].kind == "w" and k + 1 < size and tokens[k + 1].text == "=>":
        return k
    if k < size and tokens[k].text == "(":
        after = match[k] + 1
        if after < size and tokens[after].text == ":":  # the type of the result
            after += 1
            while after < size and tokens[after].text not in ("=>", ";", "=", ","):
                after = match[after] + 1 if tokens[after].kind == "(" else after + 1
        return k if after < size and tokens[after].text == "=>" else 0
    return 0


def _add_bound(tokens, first, match, add, name, head, out, line_of) -> None:
    if tokens[first].text == "(":
        add(name, head, first)
    else:
        out.append(Function(tokens[name].text, tokens[head].at, head, name, line_of(name), [tokens[first].text]))


def _python_params(tokens: list[Token], start: int, stop: int, match: dict[int, int]) -> list[str]:
    out, k, first = [], start + 1, True
    while k < stop:
        token = tokens[k]
        if token.kind == "(":
            k = match[k]
        elif token.text == ",":
            first = True
        elif first and token.kind == "w":
            out.append(token.text)
            first = False
        k += 1
    return out


def _python_spans(tokens: list[Token], text: str, ends: dict[int, int], lines: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Strings that are statements, and functions with the token at which the body begins. Places count backwards, so that what is nearest before is the first of the body."""
    match, docs, functions = _matching(tokens), [], []
    size = len(tokens)
    line_of = lambda at: bisect.bisect_right(lines, at)
    for k, token in enumerate(tokens):
        if token.kind == "s" and (token.fresh or tokens[k - 1].text == ":"):
            stop = k + 1
            while stop < size and tokens[stop].kind == "s" and not tokens[stop].fresh:
                stop += 1
            alone = stop == size or tokens[stop].fresh or tokens[stop].text == ";"
            marks = token.text[: token.text.find(token.text[-1])].lower()
            if not alone or "f" in marks or "b" in marks:
                continue
            last = tokens[stop - 1]
            end = ends.get(last.at, last.at + len(last.text))
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    value = ast.literal_eval(text[token.at : end])
            except (SyntaxError, ValueError):
                continue
            docs.append((-token.at, k, line_of(token.at), _cleaned(value)))
        elif token.kind == "w" and token.text == "def" and k + 2 < size and tokens[k + 1].kind == "w":
            first = match.get(k + 2, 0) + 1 if tokens[k + 2].text == "[" else k + 2
            if first not in match or tokens[first].text != "(":
                continue
            colon = match[first] + 1
            while colon < size and tokens[colon].text != ":":
                colon = match[colon] + 1 if tokens[colon].kind == "(" else colon + 1
            if colon + 1 < size:
                body = colon + 1
                functions.append((-tokens[body].at, body, body, line_of(tokens[body].at), tokens[k + 1].text, line_of(tokens[k + 1].at), _python_params(tokens, first, match[first], match)))
    return docs, functions


def _cleaned(doc: str) -> str:
    lines = doc.expandtabs().split("\n")
    margin = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return "\n".join([lines[0].strip(), *(x[margin:].rstrip() for x in lines[1:])]).strip()


def spans_of(language: str, text: str) -> tuple[list[tuple], list[tuple]] | None:
    """Comments (at, tokens before, last line, text) and functions (at, tokens before, tokens before the name, line, name, its line, parameters); nothing for a text that does not parse."""
    tokens: list[Token] = []
    comments: list[tuple[int, int, int]] = []
    ends: dict[int, int] = {}
    state, stop = scan(language, text, FIRST[language], tokens, comments, 0, ends)
    if stop < len(text) or not tokens_stand(language, text, tokens, state):
        return None
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    if language == "Python":
        return _python_spans(tokens, text, ends, lines)
    line_of = lambda at: bisect.bisect_right(lines, at)
    docs: list[tuple] = []
    for place, start, stop in comments:
        body = text[start:stop].rstrip("\r")
        if language == "Go" and docs and docs[-1][1] == place and line_of(start) <= docs[-1][2] + 1:
            last = docs.pop()  # comments on neighbouring lines are one
            docs.append((last[0], place, line_of(start + len(body) - 1), f"{last[3]}\n{body}"))
        else:
            docs.append((start, place, line_of(start + len(body) - 1), body))
    functions = [(f.at, f.head, f.place, line_of(f.at), f.name, f.line, f.params) for f in functions_of(language, text, tokens, lines)]
    return docs, functions


_LAYOUT = "id long, language string, kind int, at long, place int, name_place int, line int, name string, line_no int, params array<string>, doc string"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in chunks(batch, 2)):
        rows: list[tuple] = []
        for key, language, text in zip(*(part.column(k).to_pylist() for k in range(3))):
            spans = spans_of(language, text)
            if spans is None:
                continue
            docs, functions = spans
            rows.extend((key, language, 0, at, place, None, line, None, None, None, doc) for at, place, line, doc in docs)
            rows.extend((key, language, 1, at, place, own, line, name, number, params, None) for at, place, own, line, name, number, params in functions)
        columns = list(zip(*rows)) or [()] * 11
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _LAYOUT.split(", ")])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, language, name, number, params, doc in zip(*(batch.column(k).to_pylist() for k in range(6))):
            text = description(doc, language)
            if not trivial(text, name):
                rows.append((key, number, name, params, text))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "line_no", "name", "params", "doc"])


def documented_functions(df: DataFrame, key: str, language: str, content: str) -> DataFrame:
    """``key``, ``line_no``, ``name``, ``params`` and ``doc`` of each function whose documentation says something.

    Defined cases: ``key`` is a whole number; rows that repeat it are one file. Null keys, null content, other
    languages and files that do not parse (as in ``broken_files``) give no row, nor do empty files. Functions of one name on different
    lines are different rows. Files are read whole. Other columns are never read. The text is shuffled once, by
    ``key``, so that a large block of a table is not read by one task.
    """
    files = df.select(df[key].cast("long").alias("id"), spoken(df[language]).alias("language"), df[content].cast("string").alias("content")).where("id is not null and language is not null and content is not null")
    spans = files.repartition("id").mapInArrow(_spans, _LAYOUT)
    by_place = Window.partitionBy("id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.last(F.when(F.col("kind") == 0, F.struct("place", "line", "doc")), ignorenulls=True).over(by_place)
    joined = spans.withColumn("near", nearest).where("kind = 1 and near is not null")
    # a comment may also stand behind an annotation, that is inside the head
    adjacent = (F.col("near.place") >= F.col("place")) & (F.col("near.place") <= F.col("name_place"))
    above = F.when(F.col("language") == "Go", F.col("near.line") == F.col("line") - 1).when(F.col("language") == "Python", F.lit(True)).otherwise(F.col("near.line") >= F.col("line") - 1)
    marked = F.col("language").isin("Go", "Python") | (F.col("near.doc").startswith("/**") & (F.length("near.doc") > 4))
    pairs = joined.where(adjacent & above & marked).select("id", "language", "name", "line_no", "params", F.col("near.doc").alias("doc"))
    return pairs.mapInArrow(_told, "id long, line_no int, name string, params array<string>, doc string").distinct().withColumnRenamed("id", key)
