"""A small document tree over the standard HTML parser, with the CSS subset that specs use.

Selectors: type, *, .class, #id, [a], [a=v], [a~=v], [a^=v], [a$=v], [a*=v] (with an optional i flag), :scope,
:root, descendant and child combinators, and comma lists. Matching returns nodes in document order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody"}),
    "td": frozenset({"td", "th", "tr", "tbody"}),
    "th": frozenset({"td", "th", "tr", "tbody"}),
    "option": frozenset({"option"}),
}


class Node:
    """An element: its name, attributes, parent and children (nodes and strings)."""

    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    yield c
                elif c.name not in skip:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, skip: frozenset[str] = frozenset({"script", "style", "noscript", "template"})) -> str:
        """Stripped strings joined by a blank, white space runs made one."""
        return " ".join(" ".join(self.strings(skip)).split())

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def select(self, selector: str) -> list[Node]:
        paths = parse_selector(selector)
        return [n for n in self.walk() if any(_matches(n, p, self) for p in paths)]

    def first(self, selector: str) -> Node | None:
        paths = parse_selector(selector)
        return next((n for n in self.walk() if any(_matches(n, p, self) for p in paths)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at
        while node.parent is not None and tag in _CLOSES.get(node.name, ()):
            self.at = node = node.parent
        made: dict[str, str] = {}
        for k, v in attrs:
            made.setdefault(k, v or "")
        child = Node(tag, made, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.name == tag and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if data:
            self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The document tree of a page; broken markup never raises."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# ---------------------------------------------------------------- selectors


@dataclass(frozen=True)
class Step:
    """One compound selector and how it relates to the one before it (' ' or '>')."""

    link: str
    name: str | None
    tests: tuple[tuple[str, str, str, bool], ...]  # attribute, operator, value, ignore case
    scope: bool = False
    root: bool = False


_TOKEN = re.compile(
    r"""\s*(?P<child>>)\s*|(?P<space>\s+)|(?P<comma>,)|(?P<pseudo>:[\w-]+)|\.(?P<cls>(?:[\w-]|\\.)+)|\#(?P<id>(?:[\w-]|\\.)+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>(?:[^"\\]|\\.)*)"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]
    |(?P<name>\*|[A-Za-z][\w-]*)""",
    re.X,
)


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple[tuple[Step, ...], ...]:
    """Comma-separated paths of steps; a ValueError for anything outside the subset."""
    paths: list[tuple[Step, ...]] = []
    path: list[Step] = []
    state = {"link": "", "name": None, "tests": [], "scope": False, "root": False, "any": False}

    def close() -> None:
        if state["any"]:
            path.append(Step(state["link"] or " ", state["name"], tuple(state["tests"]), state["scope"], state["root"]))
        state.update(link="", name=None, tests=[], scope=False, root=False, any=False)

    at, text = 0, selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood at {at}: {selector!r}")
        at = m.end()
        if m["child"] or m["space"]:
            close()
            state["link"] = ">" if m["child"] else " "
            continue
        if m["comma"]:
            close()
            if not path:
                raise ValueError(f"empty selector in {selector!r}")
            paths.append(tuple(path))
            path = []
            at += len(text[at:]) - len(text[at:].lstrip())
            continue
        state["any"] = True
        if m["pseudo"]:
            if m["pseudo"] not in (":scope", ":root"):
                raise ValueError(f"{m['pseudo']} is not supported")
            state[m["pseudo"][1:]] = True
        elif m["cls"]:
            state["tests"].append(("class", "~=", re.sub(r"\\(.)", r"\1", m["cls"]), False))
        elif m["id"]:
            state["tests"].append(("id", "=", re.sub(r"\\(.)", r"\1", m["id"]), False))
        elif m["attr"]:
            value = next((re.sub(r"\\(.)", r"\1", m[g]) for g in ("dq", "sq", "bare") if m[g] is not None), "")
            state["tests"].append((m["attr"].lower(), m["op"] or "", value, bool(m["flag"])))
        elif m["name"] != "*":
            state["name"] = m["name"].lower()
    close()
    if not path:
        raise ValueError(f"empty selector: {selector!r}")
    return (*paths, tuple(path))


def _passes(node: Node, step: Step, scope: Node) -> bool:
    if step.scope and node is not scope or step.root and not (node.parent is not None and node.parent.parent is None and node.name == "html"):
        return False
    if step.name is not None and node.name != step.name:
        return False
    for name, op, want, fold in step.tests:
        have = node.attrs.get(name)
        if have is None:
            return False
        if fold:
            have, want = have.lower(), want.lower()
        ok = {
            "": True,
            "=": have == want,
            "~=": want in have.split(),
            "^=": bool(want) and have.startswith(want),
            "$=": bool(want) and have.endswith(want),
            "*=": bool(want) and want in have,
            "|=": have == want or have.startswith(want + "-"),
        }[op]
        if not ok:
            return False
    return True


def _matches(node: Node, path: tuple[Step, ...], scope: Node, at: int = -1) -> bool:
    step = path[at]
    if not _passes(node, step, scope):
        return False
    if -at == len(path):
        return True
    before = at - 1
    if step.link == ">":
        return node.parent is not None and _matches(node.parent, path, scope, before)
    return any(_matches(a, path, scope, before) for a in node.ancestors())
