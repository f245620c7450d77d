"""The query language: syntax tree, parser and printer.

    query      := '@'word* ( select | add | delete )
    select     := 'SELECT' ['OPTIONAL'] type ['?'name] ['WHERE' constraint*] [ '{' select ('|' select)* '}' ]
    add        := 'ADD' type ['?'name] ['WITH' assignment*] '{' select '}'
    delete     := 'DELETE' type ['?'name] '{' select '}'
    type       := ANNOTATION | DATA | KEY | TEXT | RESOURCE | DATASET
    constraint := '@'word* body ';'
    body       := ID arg | TEXT [AS NOCASE|REGEX] (arg|?var) | ANNOTATION [AS METADATA|TARGET [RECURSIVE]] (arg|?var) [offset]
                | RESOURCE [AS METADATA] (arg|?var) [offset] | DATASET [AS METADATA] (arg|?var) | RELATION ?var op
                | DATA [AS METADATA] (?var | set key [op value]) | VALUE [AS METADATA] op value | KEY [AS METADATA] ?var
                | SUBSTORE (NONE|arg|?var) | LIMIT n [m] | '[' body ('OR' body)* ']'
    offset     := OFFSET (WHOLE | begin [end])
    assignment := (ID arg | DATA set key [value] | TARGET ?var [offset] | COMPOSITE | MULTI | DIRECTIONAL) ';'
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from decimal import Decimal

from spanloom.functions import values
from spanloom.functions.spans import RELATIONS, Offset

TYPES = ("ANNOTATION", "DATA", "KEY", "TEXT", "RESOURCE", "DATASET")
_OPS = {"=": "eq", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
_TOKEN = re.compile(r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<mark>[{}|;\[\]])|(?P<word>[^\s;{}\[\]"]+))""")
_DATETIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$")


class SyntaxFault(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class Constraint:
    """kind: the keyword, or UNION. var: the variable's name; arg: literal arguments."""

    kind: str
    var: str | None = None
    arg: tuple = ()
    qualifier: str | None = None
    recursive: bool = False
    offset: Offset | None = None
    op: tuple | None = None
    parts: tuple = ()


@dataclass(frozen=True)
class Query:
    """A query as a value; the with_ methods give another one. constraint_attributes go with the constraints in their order and may be fewer."""

    verb: str
    type: str
    name: str | None = None
    optional: bool = False
    constraints: tuple = ()
    subqueries: tuple = ()
    assignments: tuple = ()
    attributes: tuple = ()
    constraint_attributes: tuple = ()

    def with_name(self, name: str) -> Query:
        return replace(self, name=name)

    def with_optional(self, optional: bool = True) -> Query:
        return replace(self, optional=optional)

    def with_attributes(self, *attributes: str) -> Query:
        return replace(self, attributes=(*self.attributes, *attributes))

    def with_constraint(self, constraint: Constraint, *attributes: str) -> Query:
        """With one more constraint behind the others, and its attributes."""
        known = tuple(own for _, own in self.constraints_with_attributes())
        return replace(self, constraints=(*self.constraints, constraint), constraint_attributes=(*known, attributes) if attributes or any(known) else ())

    def with_subquery(self, query: Query) -> Query:
        return replace(self, subqueries=(*self.subqueries, query))

    def constraints_with_attributes(self) -> list[tuple[Constraint, tuple[str, ...]]]:
        more = len(self.constraints) - len(self.constraint_attributes)
        return list(zip(self.constraints, (*self.constraint_attributes, *[()] * more), strict=True))

    def names(self) -> list[str]:
        return [n for n in [self.name, *(x for q in self.subqueries for x in q.names())] if n]

    def paths(self) -> list[tuple[int, ...]]:
        """The positions of subqueries, from the top."""
        return [(), *((i, *p) for i, q in enumerate(self.subqueries) for p in q.paths())]

    def at(self, path: tuple[int, ...]) -> Query:
        return self if not path else self.subqueries[path[0]].at(path[1:])


class _Quoted(str):
    """What stands between quotes, and in parts what stands between its bars. A bar behind a backslash is a character."""

    parts: tuple[str, ...]


def _unquoted(raw: str) -> _Quoted:
    plain = lambda x: re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x, flags=re.S)
    out = _Quoted(plain(raw))
    out.parts = tuple(map(plain, re.findall(r"(?:^|\|)((?:[^\\|]|\\.)*)", raw, re.S)))
    return out


@dataclass
class _Tokens:
    items: list = field(default_factory=list)
    at: int = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else (None, None)

    def next(self):
        if self.at >= len(self.items):
            raise SyntaxFault("the query ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def word(self, *wanted: str) -> str | None:
        """The next token if it is one of the keywords wanted."""
        kind, text = self.peek()
        if kind == "word" and text.upper() in wanted:
            self.at += 1
            return text.upper()
        return None

    def mark(self, m: str) -> bool:
        if self.peek() == ("mark", m):
            self.at += 1
            return True
        return False

    def need(self, m: str) -> None:
        if not self.mark(m):
            raise SyntaxFault(f"expected {m} and found {self.peek()[1]}")


def tokenize(text: str) -> _Tokens:
    out, at = _Tokens(), 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"can't read {text[at : at + 20]!r}")
        kind = m.lastgroup
        raw = m[kind]
        # `a|b` is a list of literals; a lone bar parts subqueries.
        if kind == "quoted":
            raw = _unquoted(raw[1:-1])
        elif kind == "word" and raw == "|":
            kind = "mark"
        out.items.append((kind, raw))
        at = m.end()
    return out


def parse(text: str) -> Query:
    t = tokenize(text)
    q = _query(t)
    if t.peek()[0]:
        raise SyntaxFault(f"text after the query: {t.peek()[1]}")
    return q


def _query(t: _Tokens, nested: bool = False) -> Query:
    attributes = _attributes(t)
    verb = t.word("SELECT", "ADD", "DELETE")
    if not verb or nested and verb != "SELECT":
        raise SyntaxFault(f"no query begins with {t.peek()[1]}")
    optional = verb == "SELECT" and bool(t.word("OPTIONAL"))
    kind = t.word(*TYPES)
    if not kind:
        raise SyntaxFault(f"unknown result type {t.peek()[1]}")
    name = _variable(t)
    constraints, own, assignments, subqueries = [], [], [], []
    if verb == "SELECT" and t.word("WHERE"):
        while t.peek()[0] and t.peek() not in (("mark", "{"), ("mark", "}"), ("mark", "|")):
            own.append(_attributes(t))
            constraints.append(_constraint(t))
            t.need(";")
    if verb == "ADD" and t.word("WITH"):
        while t.peek()[0] and t.peek() != ("mark", "{"):
            assignments.append(_assignment(t))
            t.need(";")
    if t.mark("{"):
        if not t.mark("}"):
            subqueries.append(_query(t, True))
            while t.mark("|"):
                subqueries.append(_query(t, True))
            t.need("}")
    if verb != "SELECT" and not subqueries:
        raise SyntaxFault(f"{verb} needs a subquery")
    return Query(verb, kind, name, optional, tuple(constraints), tuple(subqueries), tuple(assignments), attributes, tuple(own) if any(own) else ())


def _attributes(t: _Tokens) -> tuple[str, ...]:
    out = []
    while (x := t.peek())[0] == "word" and x[1].startswith("@"):
        out.append(t.next()[1][1:])
    return tuple(out)


def _variable(t: _Tokens) -> str | None:
    kind, text = t.peek()
    if kind == "word" and text.startswith("?"):
        t.next()
        return text[1:]
    return None


def _argument(t: _Tokens) -> str:
    kind, text = t.next()
    if kind == "mark":
        raise SyntaxFault(f"expected an argument and found {text}")
    return text


def literal(kind: str, text: str):
    """A literal's value: quoted ones are strings, others int, float, bool, None (null), a datetime, or strings."""
    if kind == "quoted":
        return str(text)
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() == "null":
        return None
    if _DATETIME.match(text):
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    return text


def _operator(t: _Tokens) -> tuple:
    sign = _argument(t)
    if sign == ".":
        key = _argument(t)
        more = t.peek()[0] == "word" and t.peek()[1] in (*_OPS, "!=", ".", "HAS")
        return values.get_key(key, _operator(t) if more else None)
    kind, text = t.next()
    if kind == "mark":
        raise SyntaxFault("an operator needs a value")
    parts = text.split("|") if kind == "word" and "|" in text else text.parts if kind == "quoted" and len(text.parts) > 1 else None
    if sign in ("=", "!="):
        one = lambda x: values.null() if x is None else values.anything() if kind == "word" and x == "any" else values.equals(x)
        op = values.either(*[one(literal(kind, p)) for p in parts]) if parts else one(literal(kind, text))
        return op if sign == "=" else values.negate(op)
    if sign == "HAS":
        return values.either(*[values.has_element(literal(kind, p)) for p in parts]) if parts else values.has_element(literal(kind, text))
    if sign in _OPS:
        x = literal(kind, text)
        if isinstance(x, str | bool) or x is None:
            raise SyntaxFault(f"{sign} needs a number or a datetime")
        return values.compare(_OPS[sign], x)
    raise SyntaxFault(f"unknown operator {sign}")


def _offset(t: _Tokens) -> Offset | None:
    if not t.word("OFFSET"):
        return None
    if t.word("WHOLE", "ALL"):
        return Offset.whole()
    b = _argument(t)
    e = _argument(t) if t.peek()[0] == "word" and re.fullmatch(r"-?\d+", t.peek()[1]) else "-0"
    return Offset.parse(f"{b}:{e}")


def _constraint(t: _Tokens) -> Constraint:
    if t.mark("["):
        parts = [_part(t)]
        while t.word("OR"):
            parts.append(_part(t))
        t.need("]")
        return Constraint("UNION", parts=tuple(parts))
    kind = t.word("ID", "TEXT", "ANNOTATION", "RESOURCE", "DATASET", "RELATION", "DATA", "VALUE", "KEY", "SUBSTORE", "LIMIT")
    if not kind:
        raise SyntaxFault(f"unknown constraint {t.peek()[1]}")
    qualifier, recursive = None, False
    if t.word("AS"):
        allowed = {"TEXT": ("NOCASE", "REGEX"), "ANNOTATION": ("METADATA", "TARGET")}.get(kind, ("METADATA",))
        qualifier = t.word(*allowed)
        if not qualifier:
            raise SyntaxFault(f"{kind} AS {t.peek()[1]} is not known")
        recursive = bool(t.word("RECURSIVE"))
    if kind == "LIMIT":
        numbers = [int(_argument(t))]
        if t.peek()[0] == "word" and re.fullmatch(r"-?\d+", t.peek()[1]):
            numbers.append(int(_argument(t)))
        return Constraint(kind, arg=(0, numbers[0]) if len(numbers) == 1 else tuple(numbers))
    if kind == "SUBSTORE" and t.word("NONE"):
        return Constraint(kind)
    if kind == "VALUE":
        return Constraint(kind, qualifier=qualifier, op=_operator(t))
    var = _variable(t)
    if kind in ("RELATION", "KEY") and not var:
        raise SyntaxFault(f"{kind} needs a variable")
    if kind == "RELATION":
        op = _argument(t).lower()
        if op not in RELATIONS[:10]:
            raise SyntaxFault(f"unknown relation {op}")
        return Constraint(kind, var, (op,))
    if kind == "DATA" and not var:
        arg, op = (_argument(t), _argument(t)), None
        if t.peek()[0] == "word" and t.peek()[1] in (*_OPS, "!=", ".", "HAS"):
            op = _operator(t)
        return Constraint(kind, None, arg, qualifier, op=op)
    if kind in ("DATA", "KEY") and t.peek()[0] == "word" and t.peek()[1] in (*_OPS, "!=", ".", "HAS"):
        return Constraint(kind, var, (), qualifier, op=_operator(t))
    arg = () if var else (_argument(t),)
    offset = _offset(t) if kind in ("ANNOTATION", "RESOURCE") else None
    return Constraint(kind, var, arg, qualifier, recursive, offset)


def _part(t: _Tokens) -> Constraint:
    """A part of a union; its attributes are left out."""
    _attributes(t)
    return _constraint(t)


def _assignment(t: _Tokens) -> Constraint:
    kind = t.word("ID", "DATA", "TARGET", "COMPOSITE", "MULTI", "DIRECTIONAL")
    if kind == "ID":
        return Constraint(kind, arg=(_argument(t),))
    if kind == "DATA":
        arg = (_argument(t), _argument(t))
        return Constraint(kind, arg=(*arg, literal(*t.next())) if t.peek()[0] in ("word", "quoted") else (*arg, None))
    if kind == "TARGET":
        var = _variable(t)
        if not var:
            raise SyntaxFault("TARGET needs a variable")
        return Constraint(kind, var, offset=_offset(t))
    if kind:
        return Constraint(kind)
    raise SyntaxFault(f"unknown assignment {t.peek()[1]}")


# --- printing ------------------------------------------------------------------------------------------------------


def _quoted(x: str) -> str:
    return f'"{_escaped(x)}"'


def _escaped(x: str) -> str:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("|", "\\|"), ("\n", "\\n"), ("\t", "\\t")):
        x = x.replace(plain, written)
    return x


def _value(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, datetime):
        return x.isoformat()
    if isinstance(x, float):
        text = format(Decimal(repr(x)), "f")
        return text if "." in text else f"{text}.0"
    return _quoted(x) if isinstance(x, str) else str(x)


def _op_text(op: tuple) -> str:
    name, *a = op
    signs = {v: k for k, v in _OPS.items()}
    if name == "null":
        return "= null"
    if name == "any":
        return "= any"
    if name in ("true", "false"):
        return f"= {name}"
    if name == "str":
        return f"= {_quoted(a[0])}"
    if name == "cmp":
        return f"{signs[a[1]]} {_value(a[2])}"
    if name == "has":
        return f"HAS {_value(a[0])}"
    if name == "key":
        return f". {_quoted(a[0])}" + (f" {_op_text(a[1])}" if a[1] else "")
    if name == "not" and (a[0][0] in ("null", "any", "true", "false", "str", "or") or a[0][:1] + a[0][2:3] == ("cmp", "eq")):
        return "!" + _op_text(a[0])
    if name == "or":
        return _list_text(op)
    raise ValueError(f"{name} has no spelling")


def _list_text(op: tuple) -> str:
    """A list of literals behind one sign: strings in quotes, or words and numbers without."""
    signs, said = zip(*[_op_text(x).split(" ", 1) for x in op[1:]], strict=True)
    if len(set(signs)) > 1 or signs[0] not in ("=", "HAS"):
        raise ValueError("alternatives of several operators have no spelling")
    strings = [x[1] if x[0] in ("str", "has") and isinstance(x[1], str) else None for x in op[1:]]
    if None not in strings:
        return f'{signs[0]} "{"|".join(map(_escaped, strings))}"'
    if any(x is not None and (not re.fullmatch(r"[^\s;{}\[\]\"|\\]+", x) or literal("word", x) != x or x == "any") for x in strings):
        raise ValueError("strings that need quotes have no spelling beside other values")
    return f"{signs[0]} {'|'.join(v if x is None else x for v, x in zip(said, strings, strict=True))}"


def _offset_text(o: Offset | None) -> str:
    if o is None:
        return ""
    sign = lambda n, from_end: f"-{abs(n)}" if from_end else str(n)
    return f" OFFSET {sign(o.begin, o.begin_from_end)} {sign(o.end, o.end_from_end)}"


def constraint_text(c: Constraint) -> str:
    if c.kind == "UNION":
        return "[ " + " OR ".join(constraint_text(p) for p in c.parts) + " ]"
    if c.kind == "LIMIT":
        return f"LIMIT {c.arg[0]} {c.arg[1]}"
    if c.kind == "SUBSTORE" and not c.arg and not c.var:
        return "SUBSTORE NONE"
    out = c.kind + (f" AS {c.qualifier}" if c.qualifier else "") + (" RECURSIVE" if c.recursive else "")
    if c.var:
        out += f" ?{c.var}"
    if c.kind == "RELATION":
        return f"{out} {c.arg[0].upper()}"
    out += "".join(f" {_quoted(a) if isinstance(a, str) else _value(a)}" for a in c.arg if not (c.kind == "DATA" and a is None))
    return out + (f" {_op_text(c.op)}" if c.op else "") + _offset_text(c.offset)


def text_of(q: Query) -> str:
    out = "".join(f"@{a} " for a in q.attributes) + q.verb + (" OPTIONAL" if q.optional else "") + f" {q.type}" + (f" ?{q.name}" if q.name else "")
    if q.constraints:
        out += " WHERE " + " ".join("".join(f"@{a} " for a in own) + constraint_text(c) + ";" for c, own in q.constraints_with_attributes())
    if q.assignments:
        out += " WITH " + " ".join(constraint_text(c) + ";" for c in q.assignments)
    if q.subqueries:
        out += " { " + " | ".join(text_of(s) for s in q.subqueries) + " }"
    return out
