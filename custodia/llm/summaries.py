"""What a chunk of source does, whatever stands before it: a map from lexer states and a summary of its brackets.

Nodes say what a scan from one place and state reads: the codes between brackets it cannot match itself (closing
ones first, then opening ones), whether something in it is broken, and how it ends. Brackets that match inside a
chunk are settled there: their content is parsed with its local grammar and becomes one symbol. A scan that meets
the closing brace of an earlier chunk ends in two further nodes, one for each thing the brace may end.

``joined`` puts two neighbours together and is associative, so chunks may be combined in any grouping.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

from custodia.llm.grammars import code_of, content_allowed, python_pair
from custodia.llm.lexing import FIRST, Token, scan

_PAIRS = {"(": ("P", ")"), "[": ("B", "]"), "{": ("C", "}"), "${": ("X", "}")}


class Node(NamedTuple):
    parts: list  #: codes, bracket, codes, bracket, ..., codes
    broken: bool
    end: object  #: the state at the end of the chunk, or the nodes after a closing brace: of a block, of a template


class Summary(NamedTuple):
    starts: dict[str, int]  #: the node of each state in which the chunk may begin
    nodes: list[Node]


def _is_open(bracket: str) -> bool:
    return bracket[-1] not in ")]}"


def _close(language: str, parts: list, bracket: str) -> bool:
    """Adds a closing bracket to ``parts``; False if it crosses another one or the content of its pair is not allowed."""
    if len(parts) < 2 or not _is_open(parts[-2]):
        parts.extend((bracket, []))
        return True
    codes, opening = parts.pop(), parts.pop()
    pair, closing = _PAIRS[opening.rpartition("\n")[2][1:]]
    if bracket[-1] != closing:
        return False
    if language == "Go" and bracket[0] == "\n":
        codes.append("\n")
    content = tuple(codes)
    if language == "Python":
        opening = opening[: opening.rfind("\n") + 1] + python_pair(pair, content) + opening[-1]
    parts[-1].append(opening)
    return content_allowed(language, pair, content)


def _extend(language: str, parts: list, more: list) -> bool:
    """Adds ``more`` behind ``parts``; False if that breaks something."""
    parts[-1].extend(more[0])
    for k in range(1, len(more), 2):
        bracket = more[k]
        if _is_open(bracket):
            parts.extend((bracket, list(more[k + 1])))
        elif not _close(language, parts, bracket):
            return False
        else:
            parts[-1].extend(more[k + 1])
    return True


def _gathered(language: str, text: str, tokens: list[Token]) -> tuple[list, bool]:
    """The parts of these tokens, and whether something in them is broken."""
    parts: list = [[]]
    held = parts[-1]
    python = language == "Python"
    for token in tokens:
        kind = token.kind
        if kind == ")":
            if not _close(language, parts, "\n" + token.text if token.fresh else token.text):
                return parts, True
            held = parts[-1]
        elif kind == "!":
            return parts, True
        else:
            margin = text[text.rfind("\n", 0, token.at) + 1 : token.at].replace("\ufeff", "").rpartition("\f")[2] if python and token.fresh else ""
            code = code_of(language, token, margin)
            if kind == "(":
                held = []
                parts.extend((code, held))
            else:
                held.append(code)
    return parts, False


def summarise(language: str, text: str, states: list[str]) -> Summary:
    """The summary of one chunk that may begin in each of ``states``."""
    known: dict[tuple[int, str], int] = {}
    nodes: list[Node | None] = []
    waiting: list[tuple[int, str]] = []

    def node(at: int, state: str) -> int:
        place = known.get((at, state))
        if place is None:
            place = known[at, state] = len(nodes)
            nodes.append(None)
            waiting.append((at, state))
        return place

    starts = {state: node(0, state) for state in states}
    while waiting:
        at, state = waiting.pop()
        tokens: list[Token] = []
        end, stop = scan(language, text, state, tokens, at=at)
        if end == "}":
            parts, broken = _gathered(language, text, tokens[:-1])
            # a bracket that opens here and is no brace cannot be closed by one
            broken = broken or len(parts) > 1 and _is_open(parts[-2])
            nodes[known[at, state]] = Node(parts, broken, None if broken else (node(stop, "v"), node(stop, "`")))
        else:
            parts, broken = _gathered(language, text, tokens)
            nodes[known[at, state]] = Node(parts, broken, end)
    return Summary(starts, nodes)


def joined(language: str, a: Summary, b: Summary) -> Summary:
    """The summary of two neighbouring chunks."""
    nodes: list[Node] = []
    shift = len(a.nodes)  # where the nodes of b come to stand
    for held in a.nodes:
        if held.broken or isinstance(held.end, tuple):
            nodes.append(held)
            continue
        place = b.starts.get(held.end)
        if place is None:  # only a here-document of which the label is not in the chunk
            nodes.append(held)
            continue
        parts, broken = [list(x) if isinstance(x, list) else x for x in held.parts], False
        while True:
            following = b.nodes[place]
            broken = following.broken or not _extend(language, parts, following.parts)
            end = following.end
            if broken or not isinstance(end, tuple) or len(parts) < 2 or not _is_open(parts[-2]):
                break
            place = end[1] if parts[-2].endswith("${") else end[0]
            if not _close(language, parts, "}"):
                broken = True
                break
        if isinstance(end, tuple):
            end = None if broken else (end[0] + shift, end[1] + shift)
        nodes.append(Node([[]] if broken else parts, broken, end))
    if any(isinstance(n.end, tuple) for n in nodes):
        nodes += [n._replace(end=(n.end[0] + shift, n.end[1] + shift)) if isinstance(n.end, tuple) else n for n in b.nodes]
    return _reached(a.starts, nodes)


def _reached(starts: dict[str, int], nodes: list[Node]) -> Summary:
    """Without the nodes that nothing leads to."""
    order: dict[int, int] = {}
    waiting = list(starts.values())
    while waiting:
        place = waiting.pop()
        if place not in order:
            order[place] = len(order)
            if isinstance(nodes[place].end, tuple):
                waiting.extend(nodes[place].end)
    kept = [nodes[p] for p in order]
    kept = [n._replace(end=(order[n.end[0]], order[n.end[1]])) if isinstance(n.end, tuple) else n for n in kept]
    return Summary({s: order[p] for s, p in starts.items()}, kept)


def stands(language: str, summary: Summary) -> bool:
    """Whether the summary of all chunks of a file is that of a valid one."""
    node = summary.nodes[summary.starts[FIRST[language]]]
    ends_well = node.end in (("", "?>") if language == "PHP" else ("", "v"))
    return not node.broken and ends_well and len(node.parts) == 1 and content_allowed(language, "", tuple(node.parts[0]))


def tokens_stand(language: str, text: str, tokens: list[Token], state: str) -> bool:
    """The same for the tokens of a whole text and the state at its end."""
    parts, broken = _gathered(language, text, tokens)
    return stands(language, Summary({FIRST[language]: 0}, [Node(parts, broken, state)]))


def packed(summary: Summary) -> bytes:
    return pickle.dumps((summary.starts, [tuple(n) for n in summary.nodes]), protocol=5)


def unpacked(held: bytes) -> Summary:
    starts, nodes = pickle.loads(held)
    return Summary(starts, [Node(*n) for n in nodes])
