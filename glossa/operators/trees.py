"""Ordered labelled trees as tables (tree_id, node_id, parent_id, child_ix, label, depth, pre, post, lft, rgt).

pre and post number nodes on the way down and up, lft and rgt are the leaf borders [lft, rgt).  Every relation between nodes is then an
equi-join on the tree with a comparison of numbers; a pattern is a chain of such joins.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "tree_id long, node_id int, parent_id int, child_ix int, label string, depth int, pre int, post int, lft int, rgt int"


def _columns(text: str) -> list[list]:
    """A bracketed tree as columns node_id, parent_id, child_ix, label, depth, pre, post, lft, rgt; an unclosed tree ends with its text."""
    parent, child, label, depth, post, lft, rgt = ([] for _ in range(7))
    stack, kids = [], []  # open nodes, and the number of children of every node
    roots = leaf = done = 0
    fresh = False
    for t in re.findall(r"\(|\)|[^\s()]+", text or ""):
        if t == ")":
            fresh = False
            if stack:
                n = stack.pop()
                post[n], rgt[n] = done, leaf
                done += 1
            continue
        if t != "(" and fresh:
            label[stack[-1]] = t
            fresh = False
            continue
        up, n = stack[-1] if stack else None, len(parent)
        parent.append(up)
        child.append(roots if up is None else kids[up])
        if up is None:
            roots += 1
        else:
            kids[up] += 1
        kids.append(0)
        depth.append(len(stack))
        lft.append(leaf)
        if t == "(":
            label.append("")
            post.append(0)
            rgt.append(0)
            stack.append(n)
            fresh = True
        else:
            leaf += 1
            label.append(t)
            post.append(done)
            rgt.append(leaf)
            done += 1
    while stack:
        n = stack.pop()
        post[n], rgt[n] = done, leaf
        done += 1
    ids = list(range(len(parent)))
    return [ids, parent, child, label, depth, ids, post, lft, rgt]


def parse(text: str) -> list[tuple]:
    """Bracketed tree to (node_id, parent_id, child_ix, label, depth, pre, post, lft, rgt) rows."""
    return list(zip(*_columns(text), strict=True))


def from_brackets(df: DataFrame, text: str = "tree") -> DataFrame:
    """Penn-style trees (tree_id, text) to nodes; one pass over Arrow batches."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in names]
            for i, t in zip(batch.column("tree_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
                made = _columns(t)
                columns[0] += [i] * len(made[0])
                for c, m in zip(columns[1:], made, strict=True):
                    c += m
                if len(columns[0]) > 1 << 17:
                    yield _batch(names, columns)
                    columns = [[] for _ in names]
            yield _batch(names, columns)

    return df.select(F.col("tree_id").cast("long").alias("tree_id"), text).mapInArrow(run, SCHEMA)


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "tree_id" else pa.string() if n == "label" else pa.int32() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def to_brackets(nodes: DataFrame) -> DataFrame:
    """(tree_id, tree): inverse of from_brackets; one tree a call."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pre")
        text = {}
        kids: dict = {}
        for r in reversed(list(pdf.itertuples())):
            below = kids.get(r.node_id, [])
            text = r.label if not below else f"({r.label} {' '.join(reversed(below))})"
            kids.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(text)
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "tree": [" ".join(reversed(kids.get(None, [])))]})

    return nodes.groupBy("tree_id").applyInPandas(one, "tree_id long, tree string")


def numbered(nodes: DataFrame) -> DataFrame:
    """Sizes: nodes below (self included), and whether a node is a leaf or a preterminal."""
    leaf = F.col("rgt") - F.col("lft") == 1
    below = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    out = nodes.join(below, ["tree_id", "node_id"], "left").na.fill(0, ["children"])
    return out.withColumn("is_leaf", F.col("children") == 0).withColumn("is_preterminal", leaf & (F.col("children") == 1))



#: Relations A op B as conditions within one tree; a and b give a node's columns by name.
RELATIONS = {
    "<<": (lambda a, b: (a("pre") < b("pre")) & (a("post") > b("post"))),
    ">>": (lambda a, b: (a("pre") > b("pre")) & (a("post") < b("post"))),
    "<": (lambda a, b: b("parent_id") == a("node_id")),
    ">": (lambda a, b: a("parent_id") == b("node_id")),
    "..": (lambda a, b: (a("pre") < b("pre")) & (a("post") < b("post"))),
    ",,": (lambda a, b: (a("pre") > b("pre")) & (a("post") > b("post"))),
    ".": (lambda a, b: a("rgt") == b("lft")),
    ",": (lambda a, b: b("rgt") == a("lft")),
    "$": (lambda a, b: (a("parent_id") == b("parent_id")) & (a("node_id") != b("node_id"))),
    "$..": (lambda a, b: (a("parent_id") == b("parent_id")) & (a("child_ix") < b("child_ix"))),
    "$,,": (lambda a, b: (a("parent_id") == b("parent_id")) & (a("child_ix") > b("child_ix"))),
    "$.": (lambda a, b: (a("parent_id") == b("parent_id")) & (a("child_ix") + 1 == b("child_ix"))),
    "$,": (lambda a, b: (a("parent_id") == b("parent_id")) & (a("child_ix") == b("child_ix") + 1)),
    "<,": (lambda a, b: (b("parent_id") == a("node_id")) & (b("child_ix") == 0)),
    ">,": (lambda a, b: (a("parent_id") == b("node_id")) & (a("child_ix") == 0)),
    "<-": (lambda a, b: (b("parent_id") == a("node_id")) & (b("child_ix") == b("siblings") - 1)),
    ">-": (lambda a, b: (a("parent_id") == b("node_id")) & (a("child_ix") == a("siblings") - 1)),
    "<:": (lambda a, b: (b("parent_id") == a("node_id")) & (b("siblings") == 1)),
    ">:": (lambda a, b: (a("parent_id") == b("node_id")) & (a("siblings") == 1)),
    "<<,": (lambda a, b: (a("pre") < b("pre")) & (a("post") > b("post")) & (a("lft") == b("lft"))),
    ">>,": (lambda a, b: (a("pre") > b("pre")) & (a("post") < b("post")) & (a("lft") == b("lft"))),
    "<<-": (lambda a, b: (a("pre") < b("pre")) & (a("post") > b("post")) & (a("rgt") == b("rgt"))),
    ">>-": (lambda a, b: (a("pre") > b("pre")) & (a("post") < b("post")) & (a("rgt") == b("rgt"))),
    "<<:": (lambda a, b: (a("pre") < b("pre")) & (a("post") > b("post")) & (a("lft") == b("lft")) & (a("rgt") == b("rgt"))),
    "==": (lambda a, b: a("node_id") == b("node_id")),
    ":": (lambda a, b: F.lit(True)),
}


def with_siblings(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("tree_id", "parent_id").agg(F.count("*").alias("siblings"))
    return nodes.join(n, (nodes.tree_id == n.tree_id) & nodes.parent_id.eqNullSafe(n.parent_id)).select(nodes["*"], "siblings")


def _label(alias: str, pattern: str, ignore: bool = False) -> Column:
    """`__` any label, `/regex/`, `a|b` alternatives, `@x` the basic category."""
    c = F.col(f"{alias}.label")
    if pattern.startswith("@"):
        c, pattern = F.regexp_extract(c, r"^(.[^-=|#^~_]*)", 1), pattern[1:]
    if pattern == "__":
        return F.lit(True)
    if pattern.startswith("/") and pattern.endswith("/"):
        return c.rlike(pattern[1:-1])
    return c.isin(*pattern.split("|"))


def search(nodes: DataFrame, head: str, *terms: tuple) -> DataFrame:
    """Matches of a pattern: (tree_id, node_id of each name, in order).

    A term is (relation, label pattern, name, from_name) with options after it: `!` before the relation for none such, `?` for optional;
    `<3` and `>-1` style relations name the i-th child (from the end if negative).  Terms are joined one after another.
    """
    ops = {t[0].lstrip("!?") for t in terms}
    # sisters are counted only where a relation asks for the last or the only child
    base = with_siblings(nodes) if any(o in ("<-", ">-", "<:", ">:") or re.fullmatch(r"[<>]-\d+", o) for o in ops) else nodes.withColumn("siblings", F.lit(0).cast("long"))
    out = base.alias("r").where(_label("r", head)).select(F.col("r.tree_id").alias("tree_id"), *(F.col(f"r.{c}").alias(f"r__{c}") for c in base.columns if c != "tree_id"))
    names = ["r"]
    for term in terms:
        op, pattern, name = term[:3]
        start = term[3] if len(term) > 3 else "r"
        negative, optional = op.startswith("!"), op.startswith("?")
        op = op.lstrip("!?")
        a = {c: F.col(f"{start}__{c}") for c in base.columns if c != "tree_id"}
        b = base.alias("b")
        indexed = re.fullmatch(r"([<>])(-?\d+)", op)
        if indexed:
            child, parent = ("b", "a") if indexed[1] == "<" else ("a", "b")
            k = int(indexed[2])
            col = lambda side, c: a[c] if side == "a" else F.col(f"b.{c}")
            at = col(child, "child_ix") == k - 1 if k > 0 else col(child, "child_ix") == col(child, "siblings") + k
            condition = (col(child, "parent_id") == col(parent, "node_id")) & at
        else:
            condition = _bind(op, start)
        condition = (out["tree_id"] == F.col("b.tree_id")) & condition & _label("b", pattern)
        if negative:
            out = out.join(b, condition, "left_anti")
            continue
        j = out.join(b, condition, "left" if optional else "inner")
        out = j.select(*(out[c] for c in out.columns), *(F.col(f"b.{c}").alias(f"{name}__{c}") for c in base.columns if c != "tree_id"))
        names.append(name)
    return out.select("tree_id", *(F.col(f"{n}__node_id").alias(n) for n in names))


#: Pairs of columns, A's and B's, that are equal where a relation holds; relations that are not named have none but the tree.
_EQUAL = {"<": ("node_id", "parent_id"), ">": ("parent_id", "node_id"), "$": ("parent_id", "parent_id"), ".": ("rgt", "lft"), ",": ("lft", "rgt"), "==": ("node_id", "node_id")}
_EQUAL |= {o: _EQUAL["$"] for o in ("$..", "$,,", "$.", "$,")} | {o: _EQUAL["<"] for o in ("<,", "<-", "<:")} | {o: _EQUAL[">"] for o in (">,", ">-", ">:")}
_EQUAL |= {o: ("lft", "lft") for o in ("<<,", ">>,", "<<:")} | {o: ("rgt", "rgt") for o in ("<<-", ">>-")}
#: Columns of B that follow from A's where a relation holds, as keys of a join.
_NEXT = {"$.": 1, "$,": -1}


def search_texts(df: DataFrame, head: str, *terms: tuple, text: str = "tree") -> DataFrame:
    """Matches in bracketed trees (tree_id, text): (tree_id, node_id of each name, label of each name as `name_label`).

    A tree is parsed and searched where it stands, some of them at a time, so nothing is shuffled or written on the way.  Terms are those of `search` that
    bind a name (no `!`, `?` or numbered child); `/regex/` is Python's.  Each row is a tree of its own, whatever its id.
    """
    ops = {t[0] for t in terms}
    if ops - set(RELATIONS):
        raise ValueError(f"relations that search_texts does not know: {sorted(ops - set(RELATIONS))}")
    names = ["r", *(t[2] for t in terms)]
    schema = ", ".join(["tree_id long", *(f"{n} int" for n in names), *(f"{n}_label string" for n in names)])
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def matches(ids: list[int], made: list[list[list]]) -> pa.RecordBatch:
        table = {c: np.concatenate([np.array(m[k], object if c == "label" else float) for m in made]) for k, c in enumerate(columns[1:])}
        n = pd.DataFrame({"tree": np.repeat(np.arange(len(ids)), [len(m[0]) for m in made]), **table})
        if any(o in ("<-", ">-", "<:", ">:") for o in ops):
            n["siblings"] = n.groupby(["tree", "parent_id"], dropna=False)["label"].transform("size")
        labels = n["label"].astype("category")
        of = lambda pattern: n[labels.map(lambda x: _matches(x, pattern)).astype(bool)] if pattern != "__" else n
        out = of(head)
        out = out[["tree"]].assign(r=out.index)
        for op, pattern, name, *start in terms:
            a, b = n.loc[out[start[0] if start else "r"]].reset_index(drop=True), of(pattern)
            keys, there = [a["tree"]], [b["tree"]]
            if op in _EQUAL:
                one, two = _EQUAL[op]
                keys, there = [*keys, a[one]], [*there, b[two]]
            if op in _NEXT:
                keys, there = [*keys, a["child_ix"] + _NEXT[op]], [*there, b["child_ix"]]
            left = pd.DataFrame(dict(enumerate(k.to_numpy() for k in keys))).assign(at=np.arange(len(a)))
            right = pd.DataFrame(dict(enumerate(k.to_numpy() for k in there))).assign(to=b.index.to_numpy())
            pairs = left.dropna().merge(right.dropna(), on=list(range(len(keys))))
            x, y = a.iloc[pairs["at"]].reset_index(drop=True), n.loc[pairs["to"]].reset_index(drop=True)
            holds = np.ones(len(pairs), bool) if op == ":" else np.asarray(RELATIONS[op](x.__getitem__, y.__getitem__), bool)
            out = out.iloc[pairs["at"][holds]].reset_index(drop=True).assign(**{name: pairs["to"][holds].to_numpy()})
        node, label = n["node_id"].to_numpy(np.int32), n["label"].to_numpy()
        found = [pa.array(np.array(ids, np.int64)[out["tree"]]), *(pa.array(node[out[x]]) for x in names), *(pa.array(label[out[x]], pa.string()) for x in names)]
        return pa.RecordBatch.from_arrays(found, ["tree_id", *names, *(f"{x}_label" for x in names)])

    def run(batches):
        ids, made, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("tree_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
                ids.append(i)
                made.append(_columns(t))
                size += len(made[-1][0])
                if size > 1 << 17:
                    yield matches(ids, made)
                    ids, made, size = [], [], 0
        if ids:
            yield matches(ids, made)

    return df.where("tree_id is not null").select(F.col("tree_id").cast("long").alias("tree_id"), text).mapInArrow(run, schema)


def _matches(label: str, pattern: str) -> bool:
    """`_label` of one label."""
    if pattern.startswith("@"):
        label, pattern = (m[1] if (m := re.match(r"(.[^-=|#^~_]*)", label)) else ""), pattern[1:]
    if pattern == "__":
        return True
    if pattern.startswith("/") and pattern.endswith("/"):
        return re.search(pattern[1:-1], label) is not None
    return label in pattern.split("|")


def _bind(op: str, start: str) -> Column:
    """The relation with its left side's columns as flattened names."""
    a = lambda c: F.col(f"{start}__{c}")
    b = lambda c: F.col(f"b.{c}")
    return RELATIONS[op](a, b)


# --- projections -------------------------------------------------------------------------------------------------------------


def leaves(nodes: DataFrame) -> DataFrame:
    n = numbered(nodes)
    return n.where("is_leaf").select("tree_id", F.col("lft").alias("position"), "label")


def tagged_yield(nodes: DataFrame) -> DataFrame:
    n = numbered(nodes)
    p = n.where("is_preterminal").select("tree_id", "node_id", F.col("label").alias("tag"))
    return n.where("is_leaf").select("tree_id", F.col("parent_id").alias("node_id"), F.col("lft").alias("position"), F.col("label").alias("word")).join(p, ["tree_id", "node_id"]).select("tree_id", "position", "word", "tag")


def constituents(nodes: DataFrame) -> DataFrame:
    return numbered(nodes).where("not is_leaf").select("tree_id", "label", F.col("lft").alias("begin"), F.col("rgt").alias("end"))


def local_trees(nodes: DataFrame) -> DataFrame:
    """Parent label with its children's labels in order."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_ix", "label"))), lambda x: x["label"]), " ").alias("children"))
    return nodes.join(kids, ["tree_id", "node_id"]).select("tree_id", "node_id", "label", "children")


def sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.count("*").alias("size"), F.max("depth").cast("long").alias("depth"))


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0] or 0


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, ancestor, depth of the ancestor), self included: one equi-join with the parents a level, and as many rows as come out."""
    up = nodes.select("tree_id", F.col("node_id").alias("ancestor"), "parent_id", F.col("depth").alias("_d"))
    now = nodes.select("tree_id", F.col("node_id").alias("node"), F.col("node_id").alias("ancestor"), "parent_id", "depth")
    out = now
    for _ in range(_deepest(nodes)):
        above = now.where("parent_id is not null").select("tree_id", "node", F.col("parent_id").alias("ancestor"))
        now = above.join(up, ["tree_id", "ancestor"]).select("tree_id", "node", "ancestor", "parent_id", F.col("_d").alias("depth"))
        out = out.union(now)
    return out.drop("parent_id")


def domination_path(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, path): labels from the root to each node, level by level."""
    n = nodes.select("tree_id", F.col("node_id").alias("node"), "parent_id", "label", "depth")
    now = n.where("parent_id is null").select("tree_id", "node", F.col("label").alias("path"))
    out = now
    for d in range(1, _deepest(nodes) + 1):
        above = now.select("tree_id", F.col("node").alias("parent_id"), F.col("path").alias("_p"))
        now = n.where(F.col("depth") == d).join(above, ["tree_id", "parent_id"]).select("tree_id", "node", F.concat_ws("/", "_p", "label").alias("path"))
        out = out.union(now)
    return out


def lowest_common(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, x, y, join): the deepest node above both."""
    anc = ancestors(nodes)
    ax, ay = anc.withColumnRenamed("node", "x"), anc.select("tree_id", F.col("node").alias("y"), "ancestor")
    return pairs.join(ax, ["tree_id", "x"]).join(ay, ["tree_id", "y", "ancestor"]).groupBy("tree_id", "x", "y").agg(F.max_by("ancestor", "depth").alias("join"))


def c_commands(nodes: DataFrame) -> DataFrame:
    """(tree_id, x, y): x's parent stands above y, x does not stand above y nor y above x."""
    x, y, p = nodes.alias("x"), nodes.alias("y"), nodes.alias("p")
    j = x.join(p, (F.col("x.tree_id") == F.col("p.tree_id")) & (F.col("x.parent_id") == F.col("p.node_id"))).join(y, (F.col("y.tree_id") == F.col("x.tree_id")) & (F.col("p.pre") < F.col("y.pre")) & (F.col("p.post") > F.col("y.post")))
    apart = (F.col("x.pre") < F.col("y.pre")) & (F.col("x.post") < F.col("y.post")) | (F.col("x.pre") > F.col("y.pre")) & (F.col("x.post") > F.col("y.post"))
    return j.where(apart).select(F.col("x.tree_id").alias("tree_id"), F.col("x.node_id").alias("x"), F.col("y.node_id").alias("y"))


#: Head rules by category.  Each part names a side to search from and categories: `left` and `right` try categories in order, `leftdis` and
#: `rightdis` take the first child of any of them; `leftexcept` and `rightexcept` take the first that is no punctuation.
HEAD_RULES = """
ADJP: left $; rightdis NNS NN JJ QP VBN VBG; left ADJP; rightdis JJP JJR JJS DT RB RBR CD IN VBD; left ADVP NP; rightexcept
JJP: left NNS NN $ QP JJ VBN VBG ADJP JJP JJR NP JJS DT FW RBR RBS SBAR RB
ADVP: left ADVP IN; rightdis RB RBR RBS JJ JJR JJS; rightdis RP DT NN CD NP VBN NNP CC FW NNS ADJP NML; rightexcept
CONJP: right CC RB IN
FRAG: rightexcept
INTJ: left
LST: right LS :
NAC: left NN NNS NML NNP NNPS NP NAC EX $ CD QP PRP VBG JJ JJS JJR ADJP JJP FW
NX: right NP NX
PP: right IN TO VBG VBN RP FW JJ; right PP
PRN: left VP NP PP SQ S SINV SBAR ADJP JJP ADVP INTJ WHNP NAC VBP JJ NN NNP; leftexcept
PRT: right RP
QP: left $ IN NNS NN JJ CD PDT DT RB NCD QP JJR JJS
RRC: right VP NP ADVP ADJP JJP PP
S: left TO VP S FRAG SBAR ADJP JJP UCP NP
SBAR: left WHNP WHPP WHADVP WHADJP IN DT S SQ SINV SBAR FRAG
SBARQ: left SQ S SINV SBARQ FRAG SBAR; leftexcept
SINV: left VBZ VBD VBP VB MD VBN VP S SINV ADJP JJP NP
SQ: left VBZ VBD VBP VB MD AUX AUXG VP SQ
UCP: rightexcept
VP: left TO VBD VBN MD VBZ VB VBG VBP VP AUX AUXG ADJP JJP NN NNS JJ NP NNP
WHADJP: left WRB WHADVP RB JJ ADJP JJP JJR
WHADVP: right WRB WHADVP
WHNP: left WDT WP WP$ WHADJP WHPP WHNP
WHPP: right IN TO FW
X: right S VP ADJP JJP NP SBAR PP X; rightexcept
NP: rightdis NN NNP NNPS NNS NML NX POS JJR; left NP PRP; rightdis $ ADJP JJP PRN FW; right CD; rightdis JJ JJS RB QP DT WDT RBR ADVP; rightexcept
NML: rightdis NN NNP NNPS NNS NX NML POS JJR; left NP PRP; rightdis $ ADJP JJP PRN; right CD; rightdis JJ JJS RB QP DT WDT RBR ADVP; rightexcept
POSSP: right POS
ROOT: left S SQ SINV SBAR FRAG
TYPO: left NN NP NML NNP NNPS TO VBD VBN MD VBZ VB VBG VBP VP ADJP JJP FRAG
ADV: right RB RBR RBS FW ADVP TO CD JJR JJ IN NP NML JJS NN
EDITED: left
VB: left TO VBD VBN MD VBZ VB VBG VBP VP AUX AUXG ADJP JJP NN NNS JJ NP NNP
META: left
XS: right IN
"""
PUNCTUATION = ("''", "``", "-LRB-", "-RRB-", ".", ":", ",")
#: Forms of be, have, do and get: with a verb phrase beside them they are auxiliaries.
_AUXILIARIES = set("be am is are was were been being 's 're 'm have has had having 've 'd do does did doing get gets got".split())


@functools.cache
def head_rules() -> dict[str, list[tuple[str, list[str]]]]:
    out = {}
    for line in HEAD_RULES.strip().splitlines():
        category, _, parts = line.partition(": ")
        out[category] = [(p.split()[0], p.split()[1:]) for p in parts.split("; ")]
    return out


def category(label: str) -> str:
    """A label without function tags and indexes."""
    return re.match(r"-[A-Z]+-|.[^-=|#^~_]*", label)[0] if label else label


def _rank(rules: list[tuple[str, list[str]]]) -> list[tuple[str | None, int, int, str]]:
    """Rules as (child's category or None for any, rank, preference, side): the least (rank, preference, place from the side) is the head."""
    out = []
    for i, (way, kids) in enumerate(rules):
        side = "left" if way.startswith("left") else "right"
        if way.endswith("except"):
            out.append((None, i, 0, side))
        else:
            out += [(k, i, 0 if way.endswith("dis") else j, side) for j, k in enumerate(kids)]
    side = "left" if rules[-1][0].startswith("left") else "right"
    return [*out, (None, len(rules), 0, side), ("*", len(rules) + 1, 0, side)]  # the last resort: no punctuation, then anything


def head_child(n, semantic: bool = False):
    """The child that heads a node by its category's rules; the first child where there are none.

    With `semantic` a verb phrase beside an auxiliary heads the phrase, so that words depend on what they mean.
    """
    cats = [category(k.label) for k in n.kids]
    if semantic and category(n.label) in ("VP", "SQ", "SINV") and "VP" in cats:
        before = n.kids[: cats.index("VP")]
        verbs = [k for k in before if category(k.label) in ("MD", "TO") or category(k.label).startswith("VB")]
        if verbs and all(category(k.label) in ("MD", "TO") or (k.kids and k.kids[0].label.lower() in _AUXILIARIES) for k in verbs):
            return n.kids[cats.index("VP")]
    if semantic and category(n.label) == "SBAR" and "S" in cats:
        return n.kids[cats.index("S")]
    rules = head_rules().get(category(n.label))
    if not rules:
        return n.kids[0]
    if semantic and "CC" in cats[1:]:  # what is joined depends on its first part
        before = range(cats.index("CC", 1))
        plain = head_child(n)
        same = [i for i in before if cats[i] == category(plain.label)]
        if same:
            return n.kids[same[0]]
    best = None
    for want, rank, taste, side in _rank(rules):
        for i, c in enumerate(cats):
            if want == "*" or c == want or want is None and c not in PUNCTUATION:
                key = (rank, taste, i if side == "left" else -i)
                best = min(best or (key, i), (key, i))
    return n.kids[best[1]]


def heads(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, head): the child by the parent's rules (see `head_child`), else its first child."""
    spark = nodes.sparkSession
    rows = [(c, k, rank, taste, side) for c, rules in head_rules().items() for k, rank, taste, side in _rank(rules)]
    # some 300 rows, fixed
    rules = spark.createDataFrame(rows, "category string, want string, rank int, taste int, side string")
    basic = F.regexp_extract("label", r"^(-[A-Z]+-|.[^-=|#^~_]*)", 1)
    k = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("kid_id"), "child_ix", basic.alias("kid"))
    p = nodes.select("tree_id", "node_id", basic.alias("category"))
    fits = (F.col("want") == F.col("kid")) | (F.col("want") == "*") | F.col("want").isNull() & ~F.col("kid").isin(*PUNCTUATION)
    pairs = p.join(k, ["tree_id", "node_id"])
    m = pairs.join(F.broadcast(rules.withColumnRenamed("category", "_c")), (F.col("category") == F.col("_c")) & fits, "left")
    place = F.when(F.col("side") == "right", -F.col("child_ix")).otherwise(F.col("child_ix"))
    return m.groupBy("tree_id", "node_id").agg(F.min_by("kid_id", F.struct(F.coalesce("rank", F.lit(99)), F.coalesce("taste", F.lit(0)), place)).alias("head"))


# --- edits -------------------------------------------------------------------------------------------------------------------


class Node:
    """A tree in memory, for edits of one tree at a time."""

    def __init__(self, label: str, kids: list[Node] | None = None):
        self.label, self.kids = label, kids or []

    def __str__(self) -> str:
        return f"({self.label} {' '.join(map(str, self.kids))})" if self.kids else self.label


def build(text: str) -> Node | None:
    made: dict[int, Node] = {}
    root = None
    for i, parent, _, label, *_ in parse(text):
        made[i] = Node(label)
        if parent is None:
            root = root or made[i]
        else:
            made[parent].kids.append(made[i])
    return root


def edit(root: Node, target: str, op: str, *args: str) -> Node | None:
    """One edit at every node whose label matches `target` in full: delete, prune, excise, relabel, insert, replace, adjoin, coindex."""
    counter = iter(range(1, 1 << 30))

    def walk(n: Node, top: bool = False) -> list[Node]:
        kids = [x for k in n.kids for x in walk(k)]
        had = bool(n.kids)
        n.kids = kids
        hit = re.fullmatch(target, n.label)
        if op == "prune" and had and not kids:
            return []
        if not hit:
            return [n]
        if op in ("delete", "prune"):
            return []
        if op == "excise":
            return kids if not top else [n]
        if op == "relabel":
            n.label = re.sub(target, args[0], n.label)
        elif op == "insert":
            at = int(args[1]) if len(args) > 1 else 0
            n.kids.insert(at if at >= 0 else len(n.kids) + 1 + at, build(args[0]))
        elif op == "replace":
            return [build(args[0])]
        elif op in ("adjoin", "adjoinH", "adjoinF"):
            new = build(args[0])
            foot = new
            while foot.kids and not foot.label.endswith("@"):
                foot = next((k for k in foot.kids if "@" in str(k)), foot.kids[0])
            foot.label = foot.label.rstrip("@") or n.label
            foot.kids = n.kids if op != "adjoinF" else [n]
            return [new]
        elif op == "coindex":
            n.label = f"{n.label}-{next(counter)}"
        return [n]

    out = walk(root, True)
    return out[0] if out else None


def rewrite(trees: DataFrame, edits: list[tuple], text: str = "tree") -> DataFrame:
    """(tree_id, tree): edits (target, op, args...) in order on each bracketed tree; a tree that is edited away is null."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf[text]:
                n = build(t)
                for target, op, *args in edits:
                    n = edit(n, target, op, *args) if n else None
                out.append(str(n) if n else None)
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "tree": out})

    return trees.select("tree_id", text).mapInPandas(run, "tree_id long, tree string")


def relabel(nodes: DataFrame, pattern: str, to: str) -> DataFrame:
    return nodes.withColumn("label", F.when(F.col("label").rlike(f"^(?:{pattern})$"), F.regexp_replace("label", pattern, to)).otherwise(F.col("label")))


def delete_subtrees(nodes: DataFrame, pattern: str) -> DataFrame:
    gone = nodes.where(F.col("label").rlike(f"^(?:{pattern})$")).select(F.col("tree_id").alias("t"), F.col("pre").alias("p0"), F.col("post").alias("p1"))
    return nodes.join(gone, (nodes.tree_id == gone.t) & (nodes.pre >= gone.p0) & (nodes.post <= gone.p1), "left_anti")


def dependencies(nodes: DataFrame) -> DataFrame:
    """Untyped edges (tree_id, governor, dependent) between children of a node and its head child."""
    h = heads(nodes)
    k = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("kid"))
    return h.join(k, ["tree_id", "node_id"]).where("head <> kid").select("tree_id", F.col("head").alias("governor"), F.col("kid").alias("dependent"))


def path_to_root(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("tree_id", "node").orderBy(F.desc("depth"))
    return ancestors(nodes).withColumn("step", F.row_number().over(w) - 1)
