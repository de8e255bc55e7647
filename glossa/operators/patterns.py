"""Tree patterns in text, edits of what they match, head children and typed dependencies; one bracketed tree a row, so nothing is shuffled.

A pattern is a node with relations to other nodes: `NP=n < (DT=d . /^NN/) !<< VP [< CD | < JJ]`.  A node is a label, `A|B`, `@A` (the
basic category), `/regex/`, `__` (any) or `=name` (the node bound before), each with `!` for its opposite and `=name` to bind it; `/regex/#1%v` takes
a group as a string that must be the same wherever `v` stands.  A relation with `!` must not hold, one with `?` need not; alternatives stand in brackets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from glossa.operators.trees import Node, build, head_child

# --- reading patterns -----------------------------------------------------------------------------------------------------------

_RELATION = re.compile(r"<<#|>>#|<#|>#|(?:<|>|\.|,)\+\([^)]*\)|<<,|<<-|<<:|>>,|>>-|>>:|<<|>>|<-?\d+|>-?\d+|<,|>,|<-|>-|<:|>:|<|>|\$\+\+|\$--|\$\+|\$-|\$\.\.|\$,,|\$\.|\$,|\$|\.\.|,,|\.|,|==|:")
_NODE = re.compile(r"(!?)(@?)(__|/(?:\\.|[^/\\])*/(?:#\d+%\w+)*|\"[^\"]*\"|[\w*'`;-]+\$?(?:\|[\w*'`;-]+\$?)*|(?==))(?:=(\w+))?")


@dataclass
class Pattern:
    """A node's test and its relations: (relation, negative, optional, pattern) or a list of alternatives, each a list of relations."""

    test: Callable[[str], bool]
    name: str | None = None
    known: bool = False  # `=name` alone: the node must be the one bound before
    groups: list[tuple[re.Pattern, int, str]] = field(default_factory=list)
    terms: list = field(default_factory=list)


def basic(label: str) -> str:
    """A label without what follows the category: function tags, indexes."""
    return re.match(r"-[A-Z]+-|.[^-=|#^~_]*", label)[0] if label else label


def _test(no: str, at: str, text: str) -> Callable[[str], bool]:
    if text == "__":
        same = lambda x: True
    elif text.startswith("/"):
        rx = re.compile(text[1 : text.rindex("/")].replace("\\/", "/"))
        same = lambda x: rx.search(x) is not None
    else:
        wanted = set(text.strip('"').split("|"))
        same = wanted.__contains__
    of = basic if at else str
    return (lambda x: not same(of(x))) if no else (lambda x: same(of(x)))


def read(text: str, macros: dict[str, str] | None = None) -> Pattern:
    """A pattern from its text; macros are names replaced before it is read."""
    for name, value in (macros or {}).items():
        text = text.replace(name, value)
    at = 0

    def skip():
        nonlocal at
        while at < len(text) and (text[at].isspace() or text[at] == "&"):
            at += 1
        return text[at : at + 1]

    def fail(what: str):
        raise ValueError(f"{what} expected at {at} of {text!r}")

    def node() -> Pattern:
        nonlocal at
        skip()
        m = _NODE.match(text, at)
        if not m or m.end() == at:
            fail("a node")
        at = m.end()
        no, cat, label, name = m.groups()
        if not label:
            return Pattern(lambda x: True, name, True)
        groups = []
        if label.startswith("/"):
            end = label.rindex("/")
            groups = [(re.compile(label[1:end].replace("\\/", "/")), int(g), v) for g, v in re.findall(r"#(\d+)%(\w+)", label[end:])]
            label = label[: end + 1]
        return Pattern(_test(no, cat, label), name, False, groups)

    def terms() -> list:
        nonlocal at
        out = []
        while (c := skip()) and c not in ")]|":
            if c == "[":
                options = []
                while c in ("[", "|"):
                    at += 1
                    options.append(terms())
                    c = skip()
                if c != "]":
                    fail("]")
                at += 1
                out.append(options)
                continue
            no = maybe = False
            while (c := text[at : at + 1]) in ("!", "?") and c:
                no, maybe = no or c == "!", maybe or c == "?"
                at += 1
            m = _RELATION.match(text, at)
            if not m:
                fail("a relation")
            at = m.end()
            if skip() == "(":
                at += 1
                below = whole()
                if skip() != ")":
                    fail(")")
                at += 1
            else:
                below = node()
            out.append((m[0], no, maybe, below))
        return out

    def whole() -> Pattern:
        nonlocal at
        if skip() == "(":
            at += 1
            out = whole()
            if skip() != ")":
                fail(")")
            at += 1
        else:
            out = node()
        out.terms += terms()
        return out

    out = whole()
    if skip():
        fail("the end")
    return out


# --- matching -------------------------------------------------------------------------------------------------------------------


class Numbered:
    """A tree's nodes in order with parents, places among sisters and leaf borders."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.up: dict[int, Node | None] = {}
        self.ix: dict[int, int] = {}
        self.span: dict[int, tuple[int, int]] = {}
        todo: list[tuple[Node, Node | None, int, bool]] = [(root, None, 0, False)]
        leaf = 0
        while todo:
            n, up, k, seen = todo.pop()
            if seen:
                self.span[id(n)] = (self.span[id(n)][0], leaf)
                continue
            self.nodes.append(n)
            self.up[id(n)], self.ix[id(n)] = up, k
            if n.kids:
                self.span[id(n)] = (leaf, leaf)
                todo.append((n, up, k, True))
                todo += [(c, n, i, False) for i, c in reversed(list(enumerate(n.kids)))]
            else:
                self.span[id(n)] = (leaf, leaf + 1)
                leaf += 1

    def parent(self, n: Node) -> list[Node]:
        return [p] if (p := self.up[id(n)]) else []

    def above(self, n: Node) -> Iterator[Node]:
        while n := self.up[id(n)]:
            yield n

    def below(self, n: Node) -> Iterator[Node]:
        for k in n.kids:
            yield k
            yield from self.below(k)

    def sisters(self, n: Node) -> list[Node]:
        return [k for p in self.parent(n) for k in p.kids if k is not n]

    def chain(self, n: Node, step: Callable[[Node], list[Node]], through: Callable[[str], bool]) -> Iterator[Node]:
        """Nodes reached by steps whose inner nodes all pass the test."""
        seen, todo = set(), list(step(n))
        while todo:
            m = todo.pop(0)
            if id(m) not in seen:
                seen.add(id(m))
                yield m
                if through(m.label):
                    todo += step(m)

    def heads(self, n: Node) -> Iterator[Node]:
        while n.kids:
            n = head_child(n)
            yield n

    def related(self, a: Node, op: str) -> Iterator[Node] | list[Node]:
        """Nodes b with `a op b`."""
        lo, hi = self.span[id(a)]
        starts = lambda n: [m for m in self.nodes if self.span[id(m)][0] == self.span[id(n)][1]]
        ends = lambda n: [m for m in self.nodes if self.span[id(m)][1] == self.span[id(n)][0]]
        if m := re.fullmatch(r"(<|>|\.|,)\+\((.*)\)", op):
            step = {"<": lambda n: n.kids, ">": self.parent, ".": starts, ",": ends}[m[1]]
            return self.chain(a, step, read(m[2]).test)
        if m := re.fullmatch(r"([<>])(-?)(\d+)", op):
            place = lambda kids: int(m[3]) - 1 if not m[2] else len(kids) - int(m[3])
            if m[1] == "<":
                k = place(a.kids)
                return [a.kids[k]] if 0 <= k < len(a.kids) else []
            return [p for p in self.parent(a) if place(p.kids) == self.ix[id(a)]]
        first = lambda n: [n.kids[0]] if n.kids else []
        last = lambda n: [n.kids[-1]] if n.kids else []
        only = lambda n: n.kids if len(n.kids) == 1 else []
        every = lambda x: True
        back = lambda f: lambda n: [p for p in self.parent(n) if f(p) and f(p)[0] is n]
        ix = self.ix[id(a)]
        table: dict[str, Callable[[], Iterator[Node] | list[Node]]] = {
            "<": lambda: a.kids, ">": lambda: self.parent(a), "<<": lambda: self.below(a), ">>": lambda: self.above(a),
            ".": lambda: starts(a), ",": lambda: ends(a), "..": lambda: [n for n in self.nodes if self.span[id(n)][0] >= hi], ",,": lambda: [n for n in self.nodes if self.span[id(n)][1] <= lo],
            "$": lambda: self.sisters(a), "$+": lambda: [n for n in self.sisters(a) if self.ix[id(n)] == ix + 1], "$-": lambda: [n for n in self.sisters(a) if self.ix[id(n)] == ix - 1],
            "$++": lambda: [n for n in self.sisters(a) if self.ix[id(n)] > ix], "$--": lambda: [n for n in self.sisters(a) if self.ix[id(n)] < ix],
            "<,": lambda: first(a), "<-": lambda: last(a), "<:": lambda: only(a), ">,": lambda: back(first)(a), ">-": lambda: back(last)(a), ">:": lambda: back(only)(a),
            "<<,": lambda: self.chain(a, first, every), "<<-": lambda: self.chain(a, last, every), "<<:": lambda: self.chain(a, only, every),
            ">>,": lambda: self.chain(a, back(first), every), ">>-": lambda: self.chain(a, back(last), every), ">>:": lambda: self.chain(a, back(only), every),
            "<#": lambda: [head_child(a)] if a.kids else [], ">#": lambda: [p for p in self.parent(a) if head_child(p) is a],
            "<<#": lambda: self.heads(a), ">>#": lambda: self.chain(a, lambda n: [p for p in self.parent(n) if head_child(p) is n], every),
            "==": lambda: [a], ":": lambda: self.nodes,
        }
        return table[{"$.": "$+", "$,": "$-", "$..": "$++", "$,,": "$--"}.get(op, op)]()


Binding = dict[str, "Node | str"]


def _at(tree: Numbered, n: Node, p: Pattern, bound: Binding) -> Iterator[Binding]:
    """All ways in which the pattern holds at a node, given what is bound."""
    if p.known:
        if bound.get(p.name) is not n:
            return
    elif not p.test(n.label):
        return
    now = dict(bound)
    for rx, group, name in p.groups:
        m = rx.search(n.label)
        if not m or now.setdefault(f"%{name}", m[group]) != m[group]:
            return
    if p.name and not p.known:
        now[p.name] = n
    yield from _terms(tree, n, p.terms, now)


def _terms(tree: Numbered, n: Node, terms: list, bound: Binding) -> Iterator[Binding]:
    if not terms:
        yield bound
        return
    term, rest = terms[0], terms[1:]
    if isinstance(term, list):
        for option in term:
            for b in _terms(tree, n, option, bound):
                yield from _terms(tree, n, rest, b)
        return
    op, no, maybe, below = term
    found = (b for m in tree.related(n, op) for b in _at(tree, m, below, bound))
    if no:
        if next(found, None) is None:
            yield from _terms(tree, n, rest, bound)
        return
    any_found = False
    for b in found:
        any_found = True
        yield from _terms(tree, n, rest, b)
    if maybe and not any_found:
        yield from _terms(tree, n, rest, bound)


def matches(root: Node, pattern: Pattern) -> Iterator[tuple[Node, Binding]]:
    """(node, bindings) for each way the pattern holds, nodes from the top on."""
    tree = Numbered(root)
    for n in tree.nodes:
        for b in _at(tree, n, pattern, {}):
            yield n, b


def find(trees: DataFrame, pattern: str, *names: str, text: str = "tree", macros: dict[str, str] | None = None) -> DataFrame:
    """(tree_id, match, name...): each match's subtree and those of bound names (strings of groups for `%v` names), as bracketed text."""
    read(pattern, macros)  # a pattern that can't be read fails here
    columns = [n.lstrip("%") for n in names]

    def run(batches):
        want = read(pattern, macros)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["tree_id"], pdf[text], strict=True):
                if root := build(t):
                    rows += [(i, str(n), *(None if (v := b.get(x)) is None else str(v) for x in names)) for n, b in matches(root, want)]
            yield pd.DataFrame(rows, columns=["tree_id", "match", *columns])

    return trees.select("tree_id", text).mapInPandas(run, "tree_id long, match string" + "".join(f", `{c}` string" for c in columns))


# --- edits ----------------------------------------------------------------------------------------------------------------------


def _copy(n: Node) -> Node:
    return Node(n.label, [_copy(k) for k in n.kids])


def _place(tree: Numbered, root: Node, new: Node, position: str, bound: Binding) -> None:
    """Puts a tree at `$+ name`, `$- name`, `>i name` or `>-i name`."""
    where, name = position.split()
    n = bound[name]
    if where in ("$+", "$-"):
        up = tree.up[id(n)]
        if up is None:
            raise ValueError("the root has no sisters")
        k = next(i for i, x in enumerate(up.kids) if x is n)
        up.kids.insert(k + (where == "$-"), new)
    else:
        k = int(where[1:])
        n.kids.insert(k - 1 if k > 0 else len(n.kids) + k + 1, new)


def _foot(n: Node) -> Node | None:
    if n.label.endswith("@"):
        return n
    return next((f for k in n.kids if (f := _foot(k))), None)


def apply_one(root: Node, op: str, bound: Binding) -> Node | None:
    """One edit in text with its names bound; the new root, or None if nothing is left."""
    verb, _, rest = op.strip().partition(" ")
    rest = rest.strip()
    tree = Numbered(root)
    top = Node("", [root])
    tree.up[id(root)] = top
    remove = lambda n: tree.up[id(n)].kids.__delitem__(next(i for i, x in enumerate(tree.up[id(n)].kids) if x is n))

    def swap(old: Node, new: list[Node]) -> None:
        up = tree.up[id(old)]
        k = next(i for i, x in enumerate(up.kids) if x is old)
        up.kids[k : k + 1] = new

    def tree_and_rest(s: str) -> tuple[Node, str]:
        """A bracketed tree, or a node's name, at the start."""
        if not s.startswith("("):
            name, _, after = s.partition(" ")
            return bound[name], after
        depth = 0
        for i, c in enumerate(s):
            depth += (c == "(") - (c == ")")
            if not depth:
                return build(s[: i + 1]), s[i + 1 :].strip()
        raise ValueError(f"no end of the tree in {s!r}")

    if verb in ("delete", "prune"):
        for name in rest.split():
            n = bound[name]
            up = tree.up[id(n)]
            remove(n)
            while verb == "prune" and up is not top and not up.kids:
                n, up = up, tree.up[id(up)]
                remove(n)
    elif verb == "excise":
        a, b = (bound[x] for x in (rest.split() * 2)[:2])
        swap(a, b.kids)
    elif verb == "relabel":
        name, _, to = rest.partition(" ")
        n = bound[name]
        if m := re.fullmatch(r"/((?:\\.|[^/\\])*)/((?:\\.|[^/\\])*)/", to):
            fill = re.sub(r"(?<!\\)=\{(\w+)\}", lambda x: bound[x[1]].label.replace("\\", "\\\\"), m[2])
            fill = re.sub(r"(?<!\\)%\{(\w+)\}", lambda x: bound[f"%{x[1]}"].replace("\\", "\\\\"), fill)
            fill = re.sub(r"\\([/=%])", r"\1", fill)
            n.label = re.sub(m[1].replace("\\/", "/"), re.sub(r"\$(\d+)", r"\\g<\1>", fill), n.label)
        else:
            n.label = to[1:-1].replace("\\/", "/") if to.startswith("/") else to
    elif verb == "insert":
        new, position = tree_and_rest(rest)
        _place(tree, root, _copy(new), position, bound)
    elif verb == "move":
        name, _, position = rest.partition(" ")
        remove(bound[name])
        _place(tree, root, bound[name], position, bound)
    elif verb == "replace":
        name, _, by = rest.partition(" ")
        swap(bound[name], [_copy(tree_and_rest(by)[0])])
    elif verb in ("adjoin", "adjoinH", "adjoinF"):
        aux, name = tree_and_rest(rest)
        target, foot = bound[name], _foot(aux)
        if foot is None:
            raise ValueError("an auxiliary tree needs a foot, a label that ends in @")
        foot.label = foot.label[:-1]
        if verb == "adjoin":
            swap(target, [aux])
            foot.kids = target.kids
        elif verb == "adjoinH":
            foot.kids, target.kids = target.kids, aux.kids
            if foot is aux:
                target.kids = foot.kids
        else:
            swap(target, [aux])
            foot.label, foot.kids = target.label, target.kids
            bound.update({k: foot for k, v in bound.items() if v is target})
    elif verb == "coindex":
        used = [int(m[1]) for n in tree.nodes if (m := re.search(r"-(\d+)$", n.label))]
        for name in rest.split():
            bound[name].label += f"-{max(used, default=0) + 1}"
    else:
        raise ValueError(f"no such edit: {verb}")
    return top.kids[0] if top.kids else None


def operate(root: Node | None, pattern: Pattern, ops: list[str], most: int = 1000) -> Node | None:
    """Edits at the first match until nothing matches; edits that never end raise."""
    for _ in range(most):
        hit = next(matches(root, pattern), None) if root else None
        if hit is None:
            return root
        bound = hit[1]
        for op in ops:
            root = apply_one(root, op, bound) if root else None
    raise RuntimeError("the edits make matches without end")


def surgery(trees: DataFrame, scripts: list[tuple[str, list[str]]], text: str = "tree") -> DataFrame:
    """(tree_id, tree): scripts of a pattern and its edits, one after another, on each tree; null for a tree that is edited away."""
    for p, _ in scripts:
        read(p)

    def run(batches):
        ready = [(read(p), ops) for p, ops in scripts]
        for pdf in batches:
            out = []
            for t in pdf[text]:
                root = build(t)
                for p, ops in ready:
                    root = operate(root, p, ops)
                out.append(str(root) if root else None)
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "tree": out})

    return trees.select("tree_id", text).mapInPandas(run, "tree_id long, tree string")


# --- transforms -----------------------------------------------------------------------------------------------------------------


def flattened(n: Node) -> Node:
    """A node with a child of its own category takes that child's children in its place, all the way down."""
    kids = [flattened(k) for k in n.kids]
    return Node(n.label, [x for k in kids for x in (k.kids if k.kids and k.label == n.label else [k])])


def spliced(n: Node, keep: Callable[[Node], bool]) -> list[Node]:
    """The tree without the nodes that fail the test, whose children move up; leaves that fail go."""
    below = [x for k in n.kids for x in spliced(k, keep)]
    return [Node(n.label, below)] if keep(n) else below


def pruned(n: Node, keep: Callable[[Node], bool]) -> Node | None:
    """The tree without subtrees whose root fails the test, and without nodes that lose all their children."""
    if not keep(n):
        return None
    kids = [x for k in n.kids if (x := pruned(k, keep))]
    return Node(n.label, kids) if kids or not n.kids else None


def normalised(n: Node) -> Node | None:
    """Without empty elements and what only they fill, function tags and indexes, and nodes over one child of their own category."""
    n = pruned(n, lambda x: x.label != "-NONE-")
    if n is None or not n.kids:
        return n
    kids = [normalised(k) for k in n.kids]
    label = basic(n.label)
    return kids[0] if len(kids) == 1 and kids[0].kids and kids[0].label == label else Node(label, kids)


TRANSFORMS: dict[str, Callable[[Node], Node | None]] = {"flatten": flattened, "normalise": normalised}


def transformed(trees: DataFrame, *steps: str | Callable[[Node], Node | None], text: str = "tree") -> DataFrame:
    """(tree_id, tree): named or given transforms in order, lazily as part of the plan; null for a tree of which nothing is left."""
    fs = [TRANSFORMS[s] if isinstance(s, str) else s for s in steps]

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf[text]:
                n = build(t)
                for f in fs:
                    n = f(n) if n else None
                out.append(str(n) if n else None)
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "tree": out})

    return trees.select("tree_id", text).mapInPandas(run, "tree_id long, tree string")


# --- typed dependencies ---------------------------------------------------------------------------------------------------------

#: Relations by the parent's category, the dependent child's, its side of the head child (-1 before, 1 after, 0 any) and the head child's category.
#: The first line that fits counts; what fits none is `dep`.
RELATIONS = [
    ("punct", ".*", r"[.,:]|``|''|-[LR]RB-", 0, ".*"),
    ("cc", ".*", "CC|CONJP", 0, ".*"),
    ("nsubj", "S|SQ|SINV", "NP|NML", -1, "VP|VB.*|MD|ADJP"),
    ("nsubj", "SINV|SQ", "NP", 1, "VB.*|MD"),
    ("csubj", "S", "SBAR|S", -1, "VP"),
    ("poss", "NP|NML", r"PRP\$|WP\$", -1, ".*"),
    ("possessive", "NP", "POS", 0, ".*"),
    ("det", "NP|NML|WHNP", "DT|WDT", -1, ".*"),
    ("predet", "NP", "PDT", -1, ".*"),
    ("num", "NP|NML", "CD|QP", -1, ".*"),
    ("nn", "NP|NML", "NN.*|NML", -1, "NN.*|NML"),
    ("amod", "NP|NML", "JJ.*|ADJP|VBN|VBG", 0, ".*"),
    ("poss", "NP", "NP", -1, "NN.*"),
    ("appos", "NP", "NP", 1, "NP|NN.*"),
    ("rcmod", "NP", "SBAR|RRC", 1, ".*"),
    ("partmod", "NP", "VP", 1, ".*"),
    ("neg", ".*", "RB=not|RB=n't|RB=never", 0, ".*"),
    ("aux", "VP|SQ|S", "MD|TO|VB.*", -1, "VP|VB.*"),
    ("prt", "VP", "PRT|RP", 1, ".*"),
    ("acomp", "VP", "ADJP|JJ.*", 1, "VB.*"),
    ("dobj", "VP", "NP", 1, "VB.*"),
    ("ccomp", "VP", "SBAR|S", 1, "VB.*|VP"),
    ("xcomp", "VP", "VP", 1, "VB.*"),
    ("pobj", "PP|WHPP", "NP|NML|WHNP", 1, "IN|TO"),
    ("pcomp", "PP", "S|SBAR|VP", 1, "IN|TO"),
    ("prep", ".*", "PP|WHPP", 0, ".*"),
    ("mark", "SBAR", "IN|DT", -1, "S"),
    ("complm", "SBAR", "WH.*", -1, "S"),
    ("advcl", "S|VP", "SBAR", 0, ".*"),
    ("advmod", ".*", "RB.*|ADVP|WRB|WHADVP", 0, ".*"),
    ("tmod", "S|VP", "NP-TMP", 0, ".*"),
]


def edges(root: Node, collapsed: bool = False, spread: bool = False) -> list[tuple[str, int, int]]:
    """(relation, governor, dependent) by leaf number, governor -1 for the root's word.

    `collapsed`: prepositions and conjunctions become part of the relation; `spread`: what governs a word governs those joined to it too.
    """
    tree = Numbered(root)
    word: dict[int, int] = {}

    def lexical(n: Node) -> int:
        """The leaf that heads a node."""
        at = id(n)
        if at not in word:
            word[at] = lexical(head_child(n, semantic=True)) if n.kids else tree.span[at][0]
        return word[at]

    leaves = [n.label for n in tree.nodes if not n.kids]
    out = [("root", -1, lexical(root))] if leaves else []
    for n in tree.nodes:
        if len(n.kids) < 2:
            continue
        head = head_child(n, semantic=True)
        at = next(i for i, k in enumerate(n.kids) if k is head)
        joined = any(basic(k.label) in ("CC", "CONJP") for k in n.kids)
        objects = [k for i, k in enumerate(n.kids) if i > at and basic(k.label) == "NP" and not k.label.startswith("NP-TMP")] if basic(n.label) == "VP" else []
        for i, k in enumerate(n.kids):
            if k is head:
                continue
            cat, leaf = basic(k.label), leaves[lexical(k)]
            if joined and i > at and cat == basic(head.label) and not re.fullmatch(r"[.,:]", cat):
                name = "conj"
            elif len(objects) == 2 and k is objects[0]:
                name = "iobj"
            elif k.label.startswith("NP-TMP"):
                name = "tmod"
            else:
                name = next((r for r, p, d, side, h in RELATIONS if re.fullmatch(p, basic(n.label)) and (re.fullmatch(d, cat) or re.fullmatch(d, f"{cat}={leaf.lower()}")) and side in (0, 1 if i > at else -1) and re.fullmatch(h, basic(head.label))), "dep")
            out.append((name, lexical(head), lexical(k)))
    if collapsed:
        out = _collapse(out, leaves)
    if spread:
        conj = [(g, d) for r, g, d in out if r.startswith("conj")]
        shared = [(r, g, d2) for g2, d2 in conj for r, g, d in out if d == g2 and not r.startswith(("conj", "root"))]
        shared += [(r, d2, d) for g2, d2 in conj for r, g, d in out if g == g2 and r == "nsubj" and not any(r2 == "nsubj" and g3 == d2 for r2, g3, _ in out)]
        out = [*out, *shared]
    return out


def _collapse(out: list[tuple[str, int, int]], leaves: list[str]) -> list[tuple[str, int, int]]:
    of_prep = {d: g for r, g, d in out if r == "prep"}
    with_object = {g for r, g, _ in out if r in ("pobj", "pcomp") and g in of_prep}
    mark = {g: d for r, g, d in out if r == "cc"}
    done = []
    for r, g, d in out:
        if r == "prep" and d in with_object or r == "cc":
            continue
        if r in ("pobj", "pcomp") and g in of_prep:
            r, g = f"prep{'c' if r == 'pcomp' else ''}_{leaves[g].lower()}", of_prep[g]
        elif r == "conj":
            r = f"conj_{leaves[mark[g]].lower()}" if g in mark else r
        done.append((r, g, d))
    return done


def dependencies(trees: DataFrame, collapsed: bool = False, spread: bool = False, text: str = "tree") -> DataFrame:
    """(tree_id, relation, governor, dependent, governor_word, dependent_word) of bracketed trees; the root's governor is -1, ROOT."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["tree_id"], pdf[text], strict=True):
                if root := build(t):
                    words = [n.label for n in Numbered(root).nodes if not n.kids]
                    rows += [(i, r, g, d, words[g] if g >= 0 else "ROOT", words[d]) for r, g, d in edges(root, collapsed, spread)]
            yield pd.DataFrame(rows, columns=["tree_id", "relation", "governor", "dependent", "governor_word", "dependent_word"])

    return trees.select("tree_id", text).mapInPandas(run, "tree_id long, relation string, governor int, dependent int, governor_word string, dependent_word string")


def dependency_path(edges_: list[tuple[str, int, int]], a: int, b: int) -> list[str]:
    """Relations from one word to another: `<relation` up to a governor, `relation>` down; empty if there is no way."""
    near: dict[int, list[tuple[str, int]]] = {}
    for r, g, d in edges_:
        near.setdefault(d, []).append((f"<{r}", g))
        near.setdefault(g, []).append((f"{r}>", d))
    seen, todo = {a}, [(a, [])]
    while todo:
        at, way = todo.pop(0)
        if at == b:
            return way
        for r, to in near.get(at, []):
            if to not in seen and to >= 0:
                seen.add(to)
                todo.append((to, [*way, r]))
    return []
