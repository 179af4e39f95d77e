"""Lexers of six languages whose work on a chunk can be summarised and composed.

``scan`` yields the tokens of a piece of source from a given state and ends with the state after it. A state is
a string: empty in code, else what has been opened and not closed (a comment, a string that may run over lines,
the text outside a script). In scripts ``v`` before it says that a value stands last, so that a slash divides.

What a closing brace of a script ends, a block or the code inside a template, is told by the bracket it matches.
If that stands in an earlier chunk, the scan of the chunk stops there and goes on in both ways.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import regex

LANGUAGES = ("Python", "JavaScript", "TypeScript", "Go", "Java", "PHP")
SCRIPTS = ("JavaScript", "TypeScript")
_NUMBER = r"0[xX][\da-fA-F_]+[nLl]?|0[bB][01_]+[nLl]?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[nLlfFdDij]?"
_OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|<=>|\?->|=>|->|::|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|==|!=|<>|<=|>=|<<|<-|:=|[-+*/%&|^.]=|&\^=?|\*\*|[-+*/%&|^~!?:;,.=<>@#\\]"
_PYTHON_OPERATORS = r"\.\.\.|\*\*=?|//=?|<<=?|>>=?|!=|==|<=|>=|->|:=|[-+*/%&|^@]=|[-+*/%&|^~:;,.=<>@]"
_SIMPLE = {"'": r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'", '"': r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'}
_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])"
_FORMATTED = "|".join(rf"(?:[fF][rR]?|[rR][fF]){q}(?:[^{q}\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|\{{(?:[^{{}}'\"\n]|'[^'\n]*'|\"[^\"\n]*\"|\{{[^{{}}\n]*\}})*\}})*{q}" for q in "'\"")


class Token(NamedTuple):
    kind: str  #: w word, n number, s string, r pattern, o operator, ( an opened and ) a closed bracket, ! what no token begins with
    text: str
    at: int
    fresh: bool  #: whether it is the first on its line


_BLANK = r"[ \t\r\f\v\u00a0\ufeff]*+"
_BLANKS = re.compile(_BLANK)


def _compiled(strings: str, comments: str, word: str, multi: str, operators: str = _OPERATORS) -> re.Pattern:
    return re.compile(rf"{_BLANK}(?:(?P<n>\n)|(?P<w>{word})|(?P<c>{comments})|(?P<m>{multi})|(?P<s>{strings})|(?P<d>{_NUMBER})|(?P<k>[()\[\]{{}}])|(?P<o>{operators}))")


_KINDS = " nwcmsdko"  #: by the groups of the rules
_WORD = r"(?:[^\W\d]|\$)[\w$\u0300-\u036f]*"
_RULES = {
    "Python": _compiled(rf"{_FORMATTED}|{_PREFIX}?(?:{'|'.join(_SIMPLE.values())})", r"\#[^\n]*|\\\r?\n", rf"(?!{_PREFIX}['\"])[^\W\d][\w\u0300-\u036f]*", rf"{_PREFIX}?(?:'''|\"\"\")", _PYTHON_OPERATORS),
    "JavaScript": _compiled("|".join(_SIMPLE.values()), r"//[^\n]*", rf"\#?{_WORD}", r"/\*|`"),
    "Go": _compiled(_SIMPLE['"'] + r"|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"]))'", r"//[^\n]*", r"[^\W\d]\w*", r"/\*|`"),
    "Java": _compiled(_SIMPLE['"'] + r"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\]))'", r"//[^\n]*", _WORD, r'/\*|"""'),
    "PHP": _compiled(r"(?!)", r"(?://|\#(?!\[))(?:(?!\?>)[^\n])*", r"\$?\\?[^\W\d](?:\w|\\(?=[^\W\d]))*|\$(?=[\${])", r"/\*|'|\"|`|<<<[ \t]*(?:\w+|'\w+'|\"\w+\")[ \t]*\r?\n|\?>"),
}
_RULES["TypeScript"] = _RULES["JavaScript"]
_PATTERN = regex.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Where each state that runs over lines ends.
_ENDS = {
    "/*": regex.compile(r"\*/"),
    "'''": regex.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"),
    '"""': regex.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'),
    "'": regex.compile(r"(?:[^'\\]|\\[\s\S])*+'"),
    '"': regex.compile(r'(?:[^"\\]|\\[\s\S])*+"'),
    "`go": regex.compile(r"[^`]*+`"),
    "`": regex.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)"),
    "`php": regex.compile(r"(?:[^`\\]|\\[\s\S])*+`"),
    "?>": regex.compile(r"<\?(?:php(?=\s|$)|=)"),
}
#: The states in which a chunk of each language may begin, besides those of a here-document, and that of a file.
STARTS = {"Python": ("", "'''", '"""'), "JavaScript": ("", "v", "/*", "v/*", "`"), "TypeScript": ("", "v", "/*", "v/*", "`"), "Go": ("", "/*", "`go"), "Java": ("", "/*", '"""'), "PHP": ("?>", "", "/*", "'", '"', "`php")}
FIRST = {x: "?>" if x == "PHP" else "" for x in LANGUAGES}
_VALUES = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_LABEL = regex.compile(r"<<<[ \t]*['\"]?(\w+)")


def _here(label: str) -> regex.Pattern:
    return regex.compile(rf"(?m)^[ \t]*{label}\b")


def _wants_value(out: list[Token]) -> bool:
    last = out[-1]
    return last.kind in "o(" or (last.kind == "w" and last.text in _VALUES)


def scan(language: str, text: str, state: str, out: list[Token], comments: list[tuple[int, int, int]] | None = None, at: int = 0, ends: dict[int, int] | None = None) -> tuple[str, int]:
    """Appends the tokens of ``text`` from ``at`` on to ``out``; returns the state and the place where the scan ends.

    That is the end of the text, or in a script the place after a closing brace that nothing scanned here opens; the
    brace is the last token then. ``comments`` gets the tokens before each comment and the places where it begins and
    ends, ``ends`` the place after each string that may run over lines.
    """
    rules, script = _RULES[language], language in SCRIPTS
    size, first, begun, opened = len(text), len(out), 0, 0
    value = state.startswith("v")
    state = state.removeprefix("v")
    fresh = not at and state in ("", "?>")
    braces: list[str] = []  # of scripts, opened here

    def after(state: str) -> str:
        wants = _wants_value(out) if len(out) > first else not value
        return "v" + state if script and state != "`" and not wants else state

    while at < size:
        if state:
            end = _here(state[3:]) if state.startswith("<<<") else _ENDS[state]
            found = end.search(text, at) if state in ("/*", "?>") or state.startswith("<<<") else end.match(text, at)
            if not found:
                return after(state), size
            if state == "/*":
                fresh = fresh or text.find("\n", at, found.end()) >= 0
                if comments is not None:
                    comments.append((len(out), begun, found.end()))
            elif state == "?>":
                fresh = True
                if found.group().endswith("="):
                    out.append(Token("w", "echo", at, True))
            elif ends is not None and len(out) > first:
                ends[opened] = found.end()
            if state == "`" and found.group(1) == "${":
                out.append(Token("(", "${", found.end() - 2, False))
                braces.append("${")
            elif state == "`":
                value = True
            at, state = found.end(), ""
            continue
        found = rules.match(text, at)
        if not found:
            at = _BLANKS.match(text, at).end()
            if at < size:
                out.append(Token("!", text[at], at, fresh))
                at, fresh = at + 1, False
            continue
        place = found.lastindex
        start, at = found.span(place)
        kind = _KINDS[place]
        token = text[start:at]
        if kind == "w" or (kind == "o" and token[0] != "/"):
            out.append(Token(kind, token, start, fresh))
            fresh = False
            continue
        if kind == "n":
            fresh = True
            continue
        if kind == "c":
            if comments is not None:
                comments.append((len(out), start, at))
            continue
        if kind == "m":
            opened = start
            if token == "?>":
                out.append(Token("o", ";", start, fresh))
                state = "?>"
            elif token == "/*":
                state, begun = "/*", start
                continue
            elif token.startswith("<<<"):
                out.append(Token("s", token, start, fresh))
                state = "<<<" + token.strip("<'\" \t\r\n")
            else:
                out.append(Token("s", token, start, fresh))
                state = {"Go": "`go", "PHP": "`php"}.get(language, "`") if token == "`" else token[-3:]
            fresh = False
            continue
        if kind == "o" and token[0] == "/" and script and (_wants_value(out) if len(out) > first else not value) and (pattern := _PATTERN.match(text, start)):
            kind, token, at = "r", pattern.group(), pattern.end()
        elif kind == "k":
            kind = "(" if token in "([{" else ")"
            if script and token == "{":
                braces.append("{")
            elif script and token == "}":
                if not braces:
                    out.append(Token(")", "}", start, fresh))
                    return "}", at
                if braces.pop() == "${":
                    out.append(Token(")", "}", start, False))
                    state = "`"
                    continue
        elif kind == "d":
            kind = "n"
            if at < size and (text[at].isalpha() or text[at] == "_"):
                kind = "!"
        out.append(Token(kind, token, start, fresh))
        fresh = False
    return after(state), size


def states_of(language: str, text: str) -> list[str]:
    """What a text can open that runs over lines: the states in which one of its chunks may begin."""
    out = [s for s in STARTS[language] if (opener := s.removeprefix("v")) in ("", "?>") or ("`" if opener[0] == "`" else opener) in text]
    if language == "PHP":
        out += sorted({"<<<" + m for m in _LABEL.findall(text)})
    return out


_LINE_END = regex.compile(r"(?<!\\)(?<!\\\r)\n")


def pieces(text: str, size: int) -> list[str]:
    """``text`` cut at line ends into chunks of ``size`` characters or a little more; no cut follows a backslash."""
    out, at = [], 0
    while at < len(text):
        found = _LINE_END.search(text, min(at + size, len(text)))
        stop = found.end() if found else len(text)
        out.append(text[at:stop])
        at = stop
    return out
