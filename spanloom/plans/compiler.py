"""Compiles queries to one DataFrame plan.

A query and each of its subqueries is a node, numbered from 0 in the order in which they stand. The rows of a node are a DataFrame with the handles of its
item and of its ancestors, `<node>_<handle>`. A constraint on a variable is a join on the ancestor's handles and never a loop; it is evaluated for the handles that the
ancestor's rows have, not for all items. Siblings are a union of rows, each with the columns of its own nodes; a parent without a row below
is dropped, unless its last subquery is optional. Order is not part of a result; LIMIT uses the order of handles (textual
order for spans), per parent row.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import Relation
from spanloom.functions.text import find
from spanloom.functions.values import test
from spanloom.model import ANNOTATION, DATASET, KEY, RESOURCE, TEXT, Store, settled, value
from spanloom.model import DATA as DATA_KIND
from spanloom.operators import collections, filters, mutations, narrowing, related, scans, traversals
from spanloom.plans.query import Constraint, Query, parse

HANDLES = {"ANNOTATION": ["a"], "TEXT": ["res", "begin", "end"], "RESOURCE": ["res"], "DATA": ["set", "data"], "KEY": ["set", "key"], "DATASET": ["set"]}
#: By constraint, the types that its variable can have.
_TAKES = {"ANNOTATION": ("ANNOTATION",), "RESOURCE": ("RESOURCE",), "DATASET": ("DATASET",), "KEY": ("KEY",), "DATA": ("DATA", "KEY"), "TEXT": ("TEXT",), "RELATION": ("ANNOTATION", "TEXT"), "SUBSTORE": ("SUBSTORE",)}
_TABLE = {"ANNOTATION": "annotations", "RESOURCE": "resources", "DATASET": "datasets", "DATA": "data", "KEY": "keys"}


class Compiler:
    """context: variables from outside, name to (type, DataFrame of handles)."""

    def __init__(self, store: Store, context: dict[str, tuple[str, DataFrame]] | None = None):
        self.store, self.context = store, context or {}

    # --- levels ---

    def select(self, q: Query) -> DataFrame:
        return self._level(q, 0, None, [])

    def _level(self, q: Query, here: int, parent: DataFrame | None, above: list[tuple[str | None, str, int]]) -> DataFrame:
        keys = [f"{here}_{h}" for h in HANDLES[q.type]]
        frame = self._items(q, here, parent, above)
        frame = frame.select(*(parent.columns if parent is not None else []), *keys)
        if not q.subqueries:
            return frame
        frame = settled(frame)  # subqueries read it as their domain and as their parents
        below = [*above, (q.name, q.type, here)]
        parts, node = [], here + 1
        for s in q.subqueries:
            parts.append(self._level(s, node, frame, below))
            node += len(list(nodes(s)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if q.subqueries[-1].optional:
            on = frame.columns
            kept = rows.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
            rows = rows.unionByName(frame.join(kept, same, "left_anti"), allowMissingColumns=True)
        return rows

    def _items(self, q: Query, here: int, parent: DataFrame | None, above) -> DataFrame:
        """The items of node here joined to their parents, by all constraints in their order."""
        handles = HANDLES[q.type]
        mine = {h: f"{here}_{h}" for h in handles}
        rename = lambda df: df.select(*[F.col(c).alias(mine.get(c, c)) for c in df.columns])

        def start(c: Constraint) -> DataFrame:
            if self._mixed(c, above):
                return reduce(lambda a, b: a.unionByName(b), map(start, c.parts)).distinct()
            pairs, x = self._pairs(q.type, c, above, parent)
            frame = rename(pairs).distinct()
            if parent is None:
                return frame
            return parent.join(frame, x) if x else parent.crossJoin(frame)

        def narrowed(frame: DataFrame, c: Constraint) -> DataFrame:
            if self._mixed(c, above):
                return reduce(lambda a, b: a.unionByName(b), [narrowed(frame, p) for p in c.parts]).distinct()
            store = self
            if parent is not None and q.type == "ANNOTATION" and c.kind in ("DATA", "VALUE") and not c.var:
                # Data are looked up for the annotations that are left.
                frame = settled(frame)
                store = self._on(frame.select(F.col(mine["a"]).alias("a")))
            pairs, x = store._pairs(q.type, c, above, parent)
            return frame.join(rename(pairs).distinct(), [*x, *mine.values()], "left_semi")

        todo = list(q.constraints)
        # A constraint on an ancestor goes first, as long as no LIMIT comes before it: then nothing is multiplied out.
        before_limit = next((i for i, c in enumerate(todo) if c.kind == "LIMIT"), len(todo))
        lead = next((i for i in range(before_limit) if None not in self._places(todo[i], above)), None)
        if lead is not None:
            todo.insert(0, todo.pop(lead))
        if todo and todo[0].kind != "LIMIT":
            frame = start(todo.pop(0))
        else:
            frame = rename(self._all(q.type)).distinct()
            frame = parent.crossJoin(frame) if parent is not None else frame
        for c in todo:
            if c.kind == "LIMIT":
                frame = collections.limit(frame, *c.arg, [mine[h] for h in handles], parent.columns if parent is not None else None)
            else:
                frame = narrowed(frame, c)
        return frame

    def _on(self, annotations: DataFrame) -> Compiler:
        """As this one, with the data and targets of these annotations and of few others."""
        count = annotations.count()
        few = {n: narrowing.narrowed(getattr(self.store, n), annotations, ["a"], count) for n in ("annotation_data", "targets")}
        return Compiler(self.store.with_tables(**few), self.context)

    def _places(self, c: Constraint, above) -> set[int | None]:
        """The ancestors that a constraint is on; None stands for no ancestor."""
        if c.kind == "UNION":
            return set().union(*(self._places(p, above) for p in c.parts))
        return {self._place(c.var, above) if c.var else None}

    def _mixed(self, c: Constraint, above) -> bool:
        """Whether a union's parts are on different variables, so that they have no columns in common."""
        return c.kind == "UNION" and len(self._places(c, above)) > 1

    def _all(self, kind: str) -> DataFrame:
        if kind == "TEXT":
            return self.store.textselections.select("res", "begin", "end")
        return scans.scan(self.store, _TABLE[kind]).select(*HANDLES[kind])

    def _place(self, var: str, above) -> int | None:
        return next((i for i in range(len(above) - 1, -1, -1) if above[i][0] == var), None)

    def _variable(self, var: str, above) -> tuple[str, DataFrame | None, str]:
        """Type, handles if the variable comes from outside, and the prefix of its columns otherwise."""
        at = self._place(var, above)
        if at is not None:
            return above[at][1], None, f"{above[at][2]}_"
        if var in self.context:
            return *self.context[var], ""
        raise KeyError(f"unknown variable ?{var}")

    # --- constraints ---

    def _pairs(self, kind: str, c: Constraint, above, parent: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """Items of a type that meet a constraint, and the ancestor's columns beside them if it is on a variable, for those of the ancestor's items that parent has."""
        if c.kind == "UNION":
            found = [self._pairs(kind, p, above, parent) for p in c.parts]
            return reduce(lambda a, b: a.unionByName(b), [f for f, _ in found]), found[0][1]
        if not c.var:
            return self._of(kind, c, self._literal(c)).select(*HANDLES[kind]), []
        source, known, prefix = self._variable(c.var, above)
        if source not in _TAKES[c.kind]:
            raise TypeError(f"{c.kind} ?{c.var}: the variable is of type {source}")
        if known is not None:
            return self._of(kind, c, (source, known)).select(*HANDLES[kind]), []
        columns = [f"{prefix}{h}" for h in HANDLES[source]]
        domain = parent.select(*columns).dropna().distinct()
        items = domain.select(*[F.col(n).alias(h) for h, n in zip(HANDLES[source], columns, strict=True)], *columns)
        return self._of(kind, c, (source, items), columns).select(*columns, *HANDLES[kind]), columns

    def _literal(self, c: Constraint) -> tuple[str, DataFrame] | None:
        table = {"ANNOTATION": "annotations", "RESOURCE": "resources", "DATASET": "datasets"}.get(c.kind)
        if table:
            return c.kind, scans.lookup(self.store, table, c.arg[0]).select(*HANDLES[c.kind])
        return None

    def _of(self, kind: str, c: Constraint, source, keep: list[str] | None = None) -> DataFrame:
        """Items (and columns `keep` of the source) for a constraint whose variable or argument is source: (type, handles)."""
        keep, s, meta = keep or [], self.store, c.qualifier == "METADATA"
        if c.kind == "ID":
            return scans.lookup(s, _TABLE[kind], c.arg[0])
        if c.kind == "SUBSTORE":
            item = {"ANNOTATION": "annotation", "RESOURCE": "resource", "DATASET": "dataset"}[kind]
            if c.var:
                return traversals.members(s, source[1], item).select(F.col("item").alias(HANDLES[kind][0]))
            ss = None if not c.arg else scans.lookup(s, "substores", c.arg[0]).select("ss").first()
            return filters.in_substore(s, self._all(kind), HANDLES[kind][0], item, None if not c.arg else ss["ss"] if ss else -2)
        if c.kind == "VALUE" or c.kind == "DATA" and not c.var:
            data = traversals.find_data(s, *c.arg, op=c.op) if c.kind == "DATA" else s.data.filter(test(F.col("value"), c.op))
            return self._by_data(kind, settled(data.select("set", "data")), meta, [], few=True)
        if c.kind == "TEXT" and not c.var:
            return self._by_text(kind, c)
        what, items = source
        if c.op is not None and what == "KEY":
            data = items.join(s.data.select("set", "key", "data", "value"), ["set", "key"]).filter(test(F.col("value"), c.op)).drop("value")
            return data if kind in ("DATA", "KEY") else self._by_data(kind, data, meta, keep)
        if c.kind == "DATA" and what == "KEY":
            return self._of(kind, replace(c, kind="KEY"), source, keep)
        if c.kind == "DATA":
            return self._by_data(kind, items, meta, keep)
        if c.kind == "KEY":
            data = items.join(s.data.select("set", "key", "data"), ["set", "key"])
            if kind == "KEY":
                return items
            if kind == "DATA":
                return data
            return self._by_data(kind, data, meta, keep)
        if c.kind == "RELATION":
            r = Relation(c.arg[0])
            if what == "ANNOTATION":
                items = settled(items)
                items = items.join(narrowing.narrowed(s.spans(), items, ["a"], items.count()).select("a", "res", "begin", "end"), "a")
            spans, known, same = items.select("res", "begin", "end", *keep).distinct(), s.textselections, related.same_columns(r)
            if same:  # few selections have a begin or an end in common with these
                spans = settled(spans)
                known = narrowing.narrowed(known, spans, ["res", *same], spans.count())
            pairs = related.join_related(spans, known, r, s.resources)
            if c.arg[0] != "equals":
                pairs = pairs.filter((F.col("begin") != F.col("r_begin")) | (F.col("end") != F.col("r_end")))
            found = pairs.select(*keep, "res", F.col("r_begin").alias("begin"), F.col("r_end").alias("end"))
            return self._by_span(kind, found, keep, few=bool(same))
        if c.kind == "TEXT":
            return self._by_span(kind, items, keep)
        if c.kind == "DATASET":
            return {
                "DATASET": lambda: items,
                "DATA": lambda: items.join(s.data.select("set", "data"), "set"),
                "KEY": lambda: items.join(s.keys.select("set", "key"), "set"),
                "ANNOTATION": lambda: items.join(s.targets.filter(F.col("kind") == DATASET).select("set", "a") if meta else s.annotation_data.select("set", "a"), "set"),
            }[kind]()
        if c.kind == "RESOURCE":
            if kind == "RESOURCE":
                return items
            if kind == "TEXT":
                if c.offset is None:
                    return items.join(s.textselections.select("res", "begin", "end"), "res")
                begin, end = c.offset.columns(F.col("textlen"))
                return items.join(s.resources.select("res", "textlen"), "res").select(*keep, "res", begin.alias("begin"), end.alias("end")).filter("begin <= end")
            return items.join(traversals.resource_annotations(s, s.resources, meta), "res")
        if c.kind == "ANNOTATION":
            return self._by_annotation(kind, c, items, keep)
        raise NotImplementedError(f"{c.kind} for {kind}")

    def _by_annotation(self, kind: str, c: Constraint, items: DataFrame, keep: list[str]) -> DataFrame:
        s, meta = self.store, c.qualifier == "METADATA"
        if kind == "ANNOTATION":
            own = items.select("a").distinct()
            if meta:
                pairs = traversals.annotation_annotations(s, own).select("a", F.col("by").alias("_to"))
            else:
                pairs = traversals.annotation_targets(s, own, c.recursive).select("a", F.col("target_a").alias("_to"))
            return items.join(pairs, "a").drop("a").withColumnRenamed("_to", "a")
        if kind == "TEXT":
            spans = items.join(s.spans().select("a", "res", "begin", "end"), "a")
            if c.offset is None:
                return spans
            begin, end = c.offset.columns(F.col("end") - F.col("begin"))
            return spans.select(*keep, "res", (F.col("begin") + begin).alias("_b"), (F.col("begin") + end).alias("_e")).withColumnsRenamed({"_b": "begin", "_e": "end"}).filter("begin <= end")
        own = items.select("a").distinct()
        if kind == "DATA":
            return items.join(traversals.annotation_data(s, own, meta), "a")
        if kind == "KEY":
            return items.join(traversals.annotation_keys(s, own, meta), "a")
        if kind == "RESOURCE":
            return items.join(traversals.annotation_resources(s, own, meta, transitive=False), "a")
        return items.join(traversals.annotation_datasets(s, own) if meta else s.annotation_data.select("a", "set").distinct(), "a")

    def _by_data(self, kind: str, data: DataFrame, meta: bool, keep: list[str], few: bool = False) -> DataFrame:
        """few: data are a settled table, and the rows that use them are told before they are moved."""
        s = self.store
        if kind == "DATA" and not meta:
            return data
        if kind == "KEY":
            return data.join(s.data.select("set", "data", "key"), ["set", "data"])
        if kind == "DATASET" and not meta:
            return data
        by = s.targets.filter(F.col("kind") == DATA_KIND).select("set", "data", "a") if meta and kind == "ANNOTATION" else s.annotation_data.select("set", "data", "a")
        if few:
            by = narrowing.narrowed(by, data, ["set", "data"], data.count())
        used = data.join(by, ["set", "data"]).select(*keep, "a").distinct()
        if kind == "ANNOTATION":
            return used
        if kind == "TEXT":
            return used.join(s.spans().select("a", "res", "begin", "end"), "a")
        if kind == "RESOURCE":
            t = s.targets.filter(F.col("kind") == RESOURCE).select("a", "res") if meta else s.spans().select("a", "res")
            return used.join(t, "a")
        if kind == "DATASET":
            return used.join(s.targets.filter(F.col("kind") == DATASET).select("a", "set"), "a")
        raise NotImplementedError(f"DATA AS METADATA for {kind}")

    def _by_span(self, kind: str, spans: DataFrame, keep: list[str], few: bool = False) -> DataFrame:
        if kind in ("TEXT", "RESOURCE"):
            return spans
        at, every = ["res", "begin", "end"], self.store.spans()
        if few:
            spans = settled(spans)
            every = narrowing.narrowed(every, spans, at, spans.count())
        found = spans.join(every.select("a", *at), at)
        if kind == "ANNOTATION":
            return found
        return self._by_data_of(kind, found.select(*keep, "a"), keep)

    def _by_data_of(self, kind: str, annotations: DataFrame, keep: list[str]) -> DataFrame:
        found = annotations.join(self.store.annotation_data.select("a", "set", "data"), "a")
        return found if kind in ("DATA", "DATASET") else found.join(self.store.data.select("set", "data", "key"), ["set", "data"])

    def _by_text(self, kind: str, c: Constraint) -> DataFrame:
        s, text = self.store, c.arg[0]
        if c.qualifier == "REGEX":
            spans = filters.selections_matching(s, s.textselections.select("res", "begin", "end"), text)
        elif kind == "TEXT":
            return find(s.resources.select("res", "text"), text, c.qualifier == "NOCASE")
        else:
            spans = find(s.resources.select("res", "text"), text, c.qualifier == "NOCASE")
        return self._by_span(kind, spans, [])


def nodes(q: Query, depth: int = 0):
    """(query, depth) of a query and all below it, in the order in which they stand."""
    yield q, depth
    for s in q.subqueries:
        yield from nodes(s, depth + 1)


def _names(q: Query) -> dict[int, str]:
    """What each node is called: its variable; nodes without one by their depth, and if there are several of a depth, by their number too."""
    out, unnamed = {}, {}
    for i, (x, depth) in enumerate(nodes(q)):
        if x.name:
            out[i] = x.name
        else:
            n = unnamed[depth] = unnamed.get(depth, 0) + 1
            out[i] = str(depth) if n == 1 else f"{depth}n{n}"
    return out


def columns(q: Query) -> dict[str, list[str]]:
    """By variable (or depth) the columns of a result. Siblings that share a variable share its columns, as far as they are of one type."""
    out: dict[str, list[str]] = {}
    for name, (x, _) in zip(_names(q).values(), nodes(q), strict=True):
        known = out.setdefault(name, [])
        known += [c for h in HANDLES[x.type] if (c := f"{name}_{h}") not in known]
    return out


def run(store: Store, text: str | Query, context: dict | None = None) -> DataFrame:
    """The rows of a SELECT: a column `<variable>_<handle>` for each handle of each node; nodes without a variable by their depth.

    A row has values for the nodes on one way down; those of siblings are null in it.
    """
    q = parse(text) if isinstance(text, str) else text
    if q.verb != "SELECT":
        raise ValueError("ADD and DELETE are done by change()")
    rows = Compiler(store, context).select(q)
    names, merged = _names(q), {}
    for c in rows.columns:
        node, handle = c.split("_", 1)
        merged.setdefault(f"{names[int(node)]}_{handle}", []).append(F.col(c))
    return rows.select(*[(F.coalesce(*x) if len(x) > 1 else x[0]).alias(n) for n, x in merged.items()])


#: All handles that an item of any type can have.
ITEM = {"a": "bigint", "res": "bigint", "begin": "int", "end": "int", "set": "bigint", "data": "bigint", "key": "bigint"}


def bindings(store: Store, text: str | Query, context: dict | None = None) -> DataFrame:
    """The rows of a SELECT with a struct for each variable: its type and the handles of ITEM; null where a row has no such item."""
    q = parse(text) if isinstance(text, str) else text
    rows, names = run(store, q, context), _names(q)
    types: dict[str, list[str]] = {}
    for i, (x, _) in enumerate(nodes(q)):
        if x.type not in types.setdefault(names[i], []):
            types[names[i]].append(x.type)
    # The type with most handles first: siblings of one variable may have types that share some.
    own = lambda name, kind: [F.col(f"`{name}_{h}`") for h in HANDLES[kind]]

    def bound(name: str):
        kinds = sorted(types[name], key=lambda k: -len(HANDLES[k]))
        kind = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in own(name, k)]), F.lit(k)) for k in kinds])
        present = {h for k in kinds for h in HANDLES[k]}
        item = F.struct(kind.alias("type"), *[(F.col(f"`{name}_{h}`") if h in present else F.lit(None)).cast(t).alias(h) for h, t in ITEM.items()])
        return F.when(kind.isNotNull(), item).alias(name)

    return rows.select(*map(bound, types))


def bound_to(rows: DataFrame, name: str | None = None, last: bool = False):
    """Of rows of bindings the item of a variable, or else the first or the last one that a row has."""
    if name is not None:
        if name not in rows.columns:
            raise KeyError(f"unknown variable ?{name}")
        return F.col(f"`{name}`")
    order = rows.columns[::-1] if last else rows.columns
    return F.coalesce(*[F.col(f"`{c}`") for c in order])


def bind(name: str, kind: str, items: DataFrame, context: dict[str, tuple[str, DataFrame]] | None = None) -> dict[str, tuple[str, DataFrame]]:
    """context with a variable for items of a type (of HANDLES, or SUBSTORE): one item or any number of them, each one once."""
    handles = HANDLES.get(kind) or {"SUBSTORE": ["ss"]}[kind]
    if missing := [h for h in handles if h not in items.columns]:
        raise ValueError(f"items of type {kind} have no {', '.join(missing)}")
    return {**(context or {}), name: (kind, items.select(*handles).dropna().distinct())}


def from_bindings(rows: DataFrame, name: str, kind: str) -> dict[str, tuple[str, DataFrame]]:
    """Items of a type that rows of bindings have in a variable, as context for another query."""
    item = bound_to(rows, name)
    found = rows.filter(item["type"] == kind).select(*[item[h].alias(h) for h in HANDLES[kind]]).distinct()
    return {name: (kind, found)}


def change(store: Store, text: str | Query, context: dict | None = None) -> Store:
    """The Store after an ADD or DELETE."""
    q = parse(text) if isinstance(text, str) else text
    sub = q.subqueries[0]
    rows = run(store, sub, context).distinct()
    types = _types(sub)
    if q.verb == "DELETE":
        name = q.name or sub.name
        kind = types.get(name, sub.type)
        prefix = name or "0"
        gone = rows.select(*[F.col(f"{prefix}_{h}").alias(h) for h in HANDLES[kind]]).dropna().distinct()
        remove = {"ANNOTATION": mutations.remove_annotations, "RESOURCE": mutations.remove_resources, "DATASET": mutations.remove_datasets, "DATA": mutations.remove_data, "KEY": mutations.remove_keys}
        return remove[kind](store, gone)
    if q.type != "ANNOTATION":
        raise NotImplementedError("ADD makes annotations")
    targets, data, new_id, complex_ = [], [], F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in q.assignments:
        if c.kind == "ID":
            new_id = F.lit(c.arg[0])
        elif c.kind == "DATA":
            data.append(F.struct(F.lit(None).cast("string").alias("id"), F.lit(c.arg[0]).alias("set"), F.lit(c.arg[1]).alias("key"), typed(c.arg[2]).alias("value")))
        elif c.kind == "TARGET":
            targets.append(_target(c, types[c.var]))
        else:
            complex_ = F.lit({"COMPOSITE": "CompositeSelector", "MULTI": "MultiSelector", "DIRECTIONAL": "DirectionalSelector"}[c.kind])
    builders = rows.select(new_id.alias("id"), complex_.alias("complex"), F.array(*targets).alias("targets"), (F.array(*data) if data else F.array()).alias("data"))
    empty = store.spark.createDataFrame([], mutations.BUILDERS)
    return mutations.annotate(store, empty.unionByName(builders.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema.fields])))


def typed(x):
    """A value column of a Python literal, with its type."""
    if x is None:
        return value("Null")
    kind = "Bool" if isinstance(x, bool) else "Int" if isinstance(x, int) else "Float" if isinstance(x, float) else "String" if isinstance(x, str) else "Datetime"
    return value(kind, F.lit(x))


def _types(q: Query) -> dict[str | None, str]:
    out = {q.name: q.type}
    for s in q.subqueries:
        out |= _types(s)
    return out


def _target(c: Constraint, kind: str):
    col = lambda h: F.col(f"{c.var}_{h}")
    part = {n.split()[0]: F.lit(None).cast(n.split()[1]) for n in mutations.TARGET.split(", ")}
    if kind == "TEXT":
        part |= {"kind": F.lit(TEXT), "resource": F.concat(F.lit("!R"), col("res").cast("string")), "begin": col("begin").cast("int"), "end": col("end").cast("int")}
    elif kind == "ANNOTATION":
        part |= {"kind": F.lit(ANNOTATION), "annotation": F.concat(F.lit("!A"), col("a").cast("string"))}
    elif kind == "RESOURCE":
        part |= {"kind": F.lit(TEXT if c.offset else RESOURCE), "resource": F.concat(F.lit("!R"), col("res").cast("string"))}
    elif kind == "DATASET":
        part |= {"kind": F.lit(DATASET), "dataset": F.concat(F.lit("!S"), col("set").cast("string"))}
    else:
        raise NotImplementedError(f"TARGET of type {kind}: use {KEY} or {DATA_KIND} in a builder")
    if c.offset and kind in ("ANNOTATION", "RESOURCE"):
        part |= {"begin": F.lit(c.offset.begin), "end": F.lit(c.offset.end), "mode": F.lit(c.offset.mode)}
    return F.struct(*[v.alias(k) for k, v in part.items()])
