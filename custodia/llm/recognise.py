"""Decides whether a word matches the rules of a local grammar in time polynomial in its length.

Rules are read in the notation that ``grammars`` uses. Each node gives, for a place in the word, the places where its
matches end, in the order in which backtracking would try them and each once; ends of named rules are kept. What
backtracking may try exponentially often is so tried once, and the answer is the same.
"""

from __future__ import annotations

import functools
import sys

_EMPTY = ("seq", ())


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.rules = text, 0, {}

    def _skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def _takes(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def choice(self) -> tuple:
        branches = [self.sequence()]
        while self._takes("|"):
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", tuple(branches))

    def sequence(self) -> tuple:
        parts = []
        while True:
            self._skip()
            if self.at >= len(self.text) or self.text[self.at] in "|)":
                return ("seq", tuple(parts))
            if (item := self.repeated(self.item())) is not None:
                parts.append(item)

    def repeated(self, item: tuple | None) -> tuple | None:
        if self._takes("*"):
            out = ("star", item)
        elif self._takes("+"):
            out = ("seq", (item, ("star", item)))
        elif self._takes("?"):
            out = ("alt", (item, _EMPTY))
        elif self._takes("{"):
            stop = self.text.index("}", self.at)
            least, most = map(int, self.text[self.at : stop].split(","))
            self.at = stop + 1
            out = _EMPTY
            for _ in range(most - least):
                out = ("alt", (("seq", (item, out)), _EMPTY))
            out = ("seq", (item,) * least + (out,))
        else:
            return item
        return ("first", out) if self._takes("+") else out

    def item(self) -> tuple | None:
        if self._takes("(?&"):
            stop = self.text.index(")", self.at)
            name, self.at = self.text[self.at : stop], stop + 1
            return ("rule", name)
        for head, wanted, back in (("(?=", True, 0), ("(?!", False, 0), ("(?<!", False, 1), ("(?<=", True, 1)):
            if self._takes(head):
                return ("look", self._inside(), wanted, back)
        if self._takes("(?:"):
            return self._inside()
        if self._takes("(?<"):
            stop = self.text.index(">", self.at)
            name, self.at = self.text[self.at : stop], stop + 1
            self.rules[name] = self._inside()
            return None
        char = self.text[self.at]
        self.at += 1
        if char == "[":
            stop = self.text.index("]", self.at)
            chars, self.at = self.text[self.at : stop], stop + 1
            within = set()
            for k, c in enumerate(chars := chars.replace("\\", "")):
                if c == "-" and 0 < k < len(chars) - 1:
                    within |= {chr(x) for x in range(ord(chars[k - 1]), ord(chars[k + 1]))}
                else:
                    within.add(c)
            return ("char", frozenset(within))
        if char == "\\":
            self.at += 1
            return ("char", frozenset(self.text[self.at - 1]))
        if char == "(":
            raise ValueError(f"not known in a grammar: {self.text[self.at - 1 : self.at + 9]}")
        return ("any",) if char == "." else ("end",) if char == "$" else ("char", frozenset(char))

    def _inside(self) -> tuple:
        out = self.choice()
        self.at += 1
        return out


@functools.cache
def read_rules(text: str) -> dict[str, tuple]:
    """The rules of a grammar by name."""
    reader = _Reader(text)
    while reader.at < len(text):
        reader.choice()
        reader.at += 1
    return reader.rules


class _Match:
    def __init__(self, rules: dict[str, tuple], word: str):
        self.rules, self.word, self.size = rules, word, len(word)
        self.known: dict[tuple[str, int], list[int]] = {}

    def ends(self, node: tuple, at: int) -> list[int]:
        kind = node[0]
        if kind == "char":
            return [at + 1] if at < self.size and self.word[at] in node[1] else []
        if kind == "rule":
            found = self.known.get((node[1], at))
            if found is None:
                found = self.known[node[1], at] = self.ends(self.rules[node[1]], at)
            return found
        if kind == "seq":
            places = [at]
            for part in node[1]:
                if len(places) == 1:
                    places = self.ends(part, places[0])
                else:
                    reached: dict[int, None] = {}
                    for place in places:
                        reached.update(dict.fromkeys(self.ends(part, place)))
                    places = list(reached)
                if not places:
                    break
            return places
        if kind == "alt":
            reached = {}
            for branch in node[1]:
                reached.update(dict.fromkeys(self.ends(branch, at)))
            return list(reached)
        if kind == "first" and node[1][0] == "star":
            while (found := self.ends(node[1][1], at)) and found[0] > at:
                at = found[0]
            return [at]
        if kind == "first":
            return self.ends(node[1], at)[:1]
        if kind == "star":
            out, seen, path = [], {at}, [(at, iter(self.ends(node[1], at)))]
            while path:  # what is reached last is tried first
                place, nexts = path[-1]
                for following in nexts:
                    if following not in seen:
                        seen.add(following)
                        path.append((following, iter(self.ends(node[1], following))))
                        break
                else:
                    out.append(place)
                    path.pop()
            return out
        if kind == "look":
            return [at] if (at >= node[3] and bool(self.ends(node[1], at - node[3]))) == node[2] else []
        if kind == "any":
            return [at + 1] if at < self.size else []
        return [at] if at == self.size else []


def matches(grammar: str, names: tuple[str, ...], word: str, length: int | None = None) -> bool:
    """Whether one of the named rules matches the first ``length`` symbols of ``word``, by default all."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10_000_000))  # calls of Python functions take no stack of the system
    try:
        match = _Match(read_rules(grammar), word)
        wanted = len(word) if length is None else length
        return any(wanted in match.ends(("rule", name), 0) for name in names)
    finally:
        sys.setrecursionlimit(limit)
