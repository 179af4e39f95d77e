"""What lines of source declare, by language.

A rule is a language, a kind and a pattern over one line. Group 1 is the name, group 2 what a type extends and group 3
what it implements, where the language has them. The first rule of a language that fits a line holds. All patterns
keep to what the engines of Spark, Python and DuckDB have in common.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    language: str
    kind: str
    pattern: str


_JS = r"[A-Za-z_$][A-Za-z0-9_$]*"
_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_GENERIC = r"(?:<[^>]*>)?"
_JAVA_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|synchronized|native|default|strictfp)\s+)*"
_SHARP_MODIFIERS = r"(?:(?:public|protected|private|internal|static|sealed|abstract|partial|readonly|virtual|override|async|unsafe|new|extern)\s+)*"
_PHP_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*"
_SCRIPT_MODIFIERS = r"(?:(?:public|protected|private|static|async|override|readonly|abstract|get|set)\s+)*"

_SCRIPT_RULES = [
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_JS}){_GENERIC}(?:\s+extends\s+([A-Za-z_$][A-Za-z0-9_$.]*){_GENERIC})?(?:\s+implements\s+([^{{]+))?"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_JS})\s*{_GENERIC}\("),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_JS})(?:\s*:[^=]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:\s*[^=]+)?|{_JS})\s*=>"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_JS})(?:\s*:[^=]+)?\s*=\s*(?:async\s+)?function\b"),
    ("method", rf"^\s+{_SCRIPT_MODIFIERS}\*?\s*(#?{_JS})\s*{_GENERIC}\([^;]*\{{\s*$"),
]
_TYPED_RULES = [
    ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+({_JS}){_GENERIC}(?:\s+extends\s+([^{{]+))?"),
    ("enum", rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+({_JS})"),
    ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({_JS}){_GENERIC}\s*="),
]
_C_RULES = [
    ("type", rf"^\s*(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?)\s+({_ID})(?:\s+final)?\s*(?::\s*(?:public|protected|private)?\s*([A-Za-z_][A-Za-z0-9_:]*))?[^;]*$"),
    ("function", rf"^[A-Za-z_][A-Za-z0-9_:<>,*& \t]*[*& \t]+(?:{_ID}::)*(~?{_ID})\s*\([^;]*$"),
]

RULES = [
    Rule("Python", "class", rf"^\s*class\s+({_ID})(?:\[[^\]]*\])?\s*(?:\(([^)]*)\))?\s*:"),
    Rule("Python", "function", rf"^\s*(?:async\s+)?def\s+({_ID})\s*[\[(]"),
    *(Rule("JavaScript", *r) for r in _SCRIPT_RULES),
    *(Rule("TypeScript", *r) for r in _TYPED_RULES + _SCRIPT_RULES),
    *(Rule("Vue", *r) for r in _TYPED_RULES + _SCRIPT_RULES),
    Rule("Go", "struct", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+struct\b"),
    Rule("Go", "interface", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+interface\b"),
    Rule("Go", "type", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+[^\s=(]"),
    Rule("Go", "method", rf"^func\s+\([^)]*\)\s*({_ID})\s*\("),
    Rule("Go", "function", rf"^func\s+({_ID})\s*[\[(]"),
    Rule("Java", "interface", rf"^\s*{_JAVA_MODIFIERS}interface\s+({_ID}){_GENERIC}(?:\s+extends\s+([^{{]+))?"),
    Rule("Java", "annotation", rf"^\s*{_JAVA_MODIFIERS}@interface\s+({_ID})"),
    Rule("Java", "class", rf"^\s*{_JAVA_MODIFIERS}class\s+({_ID}){_GENERIC}(?:\s+extends\s+([A-Za-z_][A-Za-z0-9_.]*){_GENERIC})?(?:\s+implements\s+([^{{]+))?"),
    Rule("Java", "enum", rf"^\s*{_JAVA_MODIFIERS}enum\s+({_ID})()(?:\s+implements\s+([^{{]+))?"),
    Rule("Java", "record", rf"^\s*{_JAVA_MODIFIERS}record\s+({_ID}){_GENERIC}\([^)]*\)()(?:\s+implements\s+([^{{]+))?"),
    Rule("Java", "constructor", rf"^\s+(?:(?:public|protected|private)\s+)?([A-Z][A-Za-z0-9_]*)\s*\([^;=]*\{{?\s*$"),
    Rule("Java", "method", rf"^\s+{_JAVA_MODIFIERS}(?:<[^>]+>\s+)?[A-Za-z_][A-Za-z0-9_.]*(?:<[^()]*>)?(?:\[\])*\s+({_ID})\s*\([^;=]*[;{{,(]?\s*$"),
    Rule("PHP", "namespace", r"^\s*namespace\s+([A-Za-z_][A-Za-z0-9_\\]*)\s*[;{]"),
    Rule("PHP", "class", rf"^\s*{_PHP_MODIFIERS}class\s+({_ID})(?:\s+extends\s+([A-Za-z_\\][A-Za-z0-9_\\]*))?(?:\s+implements\s+([^{{]+))?"),
    Rule("PHP", "interface", rf"^\s*interface\s+({_ID})(?:\s+extends\s+([^{{]+))?"),
    Rule("PHP", "trait", rf"^\s*trait\s+({_ID})"),
    Rule("PHP", "enum", rf"^\s*enum\s+({_ID})(?:\s*:\s*\w+)?()(?:\s+implements\s+([^{{]+))?"),
    Rule("PHP", "function", rf"^\s*{_PHP_MODIFIERS}function\s+&?({_ID})\s*\("),
    *(Rule("C", *r) for r in _C_RULES),
    *(Rule("C++", *r) for r in _C_RULES),
    Rule("C#", "namespace", r"^\s*namespace\s+([A-Za-z_][A-Za-z0-9_.]*)"),
    Rule("C#", "interface", rf"^\s*{_SHARP_MODIFIERS}interface\s+({_ID}){_GENERIC}(?:\s*:\s*([^{{]+))?"),
    Rule("C#", "class", rf"^\s*{_SHARP_MODIFIERS}(?:class|record|struct)\s+({_ID}){_GENERIC}(?:\s*:\s*([^{{]+))?"),
    Rule("C#", "enum", rf"^\s*{_SHARP_MODIFIERS}enum\s+({_ID})"),
    Rule("C#", "method", rf"^\s+(?:(?:public|protected|private|internal|static|virtual|override|async|abstract)\s+)+[A-Za-z_][A-Za-z0-9_.]*(?:<[^()]*>)?(?:\[\])?\??\s+({_ID})\s*{_GENERIC}\("),
    Rule("Rust", "struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+({_ID})"),
    Rule("Rust", "enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+({_ID})"),
    Rule("Rust", "trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_ID})(?:\s*:\s*([^{{]+))?"),
    Rule("Rust", "impl", rf"^\s*impl{_GENERIC}\s+(?:{_ID}{_GENERIC}\s+for\s+)?({_ID})"),
    Rule("Rust", "function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+({_ID})"),
]
#: Kinds that other declarations may lie in.
TYPE_KINDS = ["class", "interface", "enum", "record", "annotation", "trait", "struct", "type", "impl"]
#: Words that a rule for methods may take for a name.
NO_NAMES = ["if", "for", "while", "switch", "catch", "return", "function", "else", "new", "throw", "do", "try", "with", "foreach", "match", "synchronized", "assert", "elseif", "using", "lock", "sizeof"]

#: What a line imports: the language, a pattern of the whole line, and whether the words of group 2 each are imported from group 1.
IMPORT_RULES = [
    ("Python", r"^\s*from\s+([A-Za-z_.][A-Za-z0-9_.]*)\s+import\s+\(?([^()#]*)", True),
    ("Python", r"^\s*import\s+()([A-Za-z_][^#;]*)", True),
    ("JavaScript", r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]()", False),
    ("TypeScript", r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]()", False),
    ("Vue", r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]()", False),
    ("Go", r"^(?:import\s+|\t)(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?\"([^\"]+)\"()\s*$", False),
    ("Java", r"^\s*import\s+((?:static\s+)?[A-Za-z_][A-Za-z0-9_.*]*\s*;)()", False),
    ("PHP", r"^use\s+((?:function\s+|const\s+)?[A-Za-z_\\][A-Za-z0-9_\\]*)()", False),
    ("C", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]()", False),
    ("C++", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]()", False),
    ("C#", r"^\s*(?:global\s+)?using\s+((?:static\s+)?[A-Za-z_][A-Za-z0-9_.]*\s*;)()", False),
    ("Rust", r"^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+([A-Za-z_][A-Za-z0-9_:]*)()", False),
]
#: Calls in a line: what is called, with what it is called on, before an opening bracket.
CALL = r"((?:[A-Za-z_$][A-Za-z0-9_$]*(?:\.|->|::|\?\.))*[A-Za-z_$][A-Za-z0-9_$]*!?)\("
NO_CALLS = [*NO_NAMES, "def", "class", "func", "fn", "elif", "except", "and", "or", "not", "in", "is", "lambda", "print", "print!", "len", "super", "array", "list", "isset", "empty", "unset", "echo", "select", "defer", "range", "make", "append", "function", "await", "typeof", "import", "from", "yield", "del"]
COMMENT_LINE = r"^\s*(?://|\*|/\*|#[^!\[i]|#$)"
#: Lines that declare a function, of which the name is no call.
DECLARES = r"^\s*(?:(?:export|default|public|protected|private|static|final|abstract|async|override|pub|unsafe|virtual|internal)\s+)*(?:def|function|func|fn|class|interface|import|use|using|package)\b|^\s*(?:(?:public|protected|private|static|final|abstract|async|override|internal|virtual)\s+)+[^=;]*\([^;]*\{\s*$"
