"""Object-set queries as immutable trees: canonical text, explanation, digest, rewrites."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

#: Part of every digest; raise it when an operator's meaning changes.
SEMANTICS = 1

# What the primitive queries say about their objects.
PRIMITIVES = {
    "MutableObj": "are changed outside their constructor",
    "ImmutableObj": "are never changed outside their constructor",
    "StationaryObj": "are never changed after being read from",
    "UniqueObj": "are never aliased",
    "HeapUniqueObj": "are never aliased on the heap",
    "TinyObj": "do not have or do not use reference type fields",
    "StackBoundObj": "are never stored in a field",
    "AgeOrderedObj": "are only holding field references to objects created before them",
    "ReverseAgeOrderedObj": "are only holding field references to objects created after them",
    "ThreadLocalObj": "are accessed from only one thread",
    "Obj": "were traced",
}
INTERNAL = {
    "NonThreadLocalObj": "are accessed from several threads",
    "NonStationaryObj": "are changed after being read from",
}
CONNECTIVES = {
    "RefersTo": "are referring to objects that",
    "HeapRefersTo": "are field-referring to objects that",
    "ReferredFrom": "are referred to from objects that",
    "HeapReferredFrom": "are field-referred to from objects that",
    "ReachableFrom": "are reachable from objects that",
    "HeapReachableFrom": "are heap-reachable from objects that",
    "CanReach": "can reach objects that",
    "CanHeapReach": "can heap-reach objects that",
}
CLOSURES = ("ReachableFrom", "HeapReachableFrom", "CanReach", "CanHeapReach")


class Query:
    """A set of object ids. ``children`` are its sub-queries; ``str`` gives text that parses back to it."""

    children: tuple[Query, ...] = ()

    def explanation(self) -> str:
        raise NotImplementedError

    def desugared(self) -> Query:
        """The same set by simpler operators."""
        return self


@dataclass(frozen=True)
class Primitive(Query):
    name: str

    def __str__(self):
        return f"{self.name}()"

    def explanation(self):
        return (PRIMITIVES | INTERNAL)[self.name]

    def desugared(self):
        inner = {"ImmutableObj": "MutableObj", "StationaryObj": "NonStationaryObj", "ThreadLocalObj": "NonThreadLocalObj"}.get(self.name)
        return Not(Primitive(inner)) if inner else self


@dataclass(frozen=True)
class InstanceOf(Query):
    klass: str

    def __str__(self):
        return f"InstanceOf({self.klass})"

    def explanation(self):
        return f"are instances of class {self.klass}"


@dataclass(frozen=True)
class AllocatedAt(Query):
    file: str
    line: int

    def __str__(self):
        return f"AllocatedAt({self.file}:{self.line})"

    def explanation(self):
        return f"were allocated at {self.file}:{self.line}"


@dataclass(frozen=True)
class Ids(Query):
    values: tuple[int, ...]

    def __str__(self):
        return f"Set({' '.join(map(str, self.values))})"

    def explanation(self):
        return "any of {" + ", ".join(map(str, self.values)) + "}"


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...]
    word = "and"

    @property
    def children(self):
        return self.parts

    def __str__(self):
        return f"{type(self).__name__}({' '.join(map(str, self.parts))})"

    def explanation(self):
        return f", {self.word} ".join(p.explanation() for p in self.parts)


@dataclass(frozen=True)
class Or(And):
    word = "or"


@dataclass(frozen=True)
class Not(Query):
    inner: Query

    @property
    def children(self):
        return (self.inner,)

    def __str__(self):
        return f"Not({self.inner})"

    def explanation(self):
        return f"not {self.inner.explanation()}"


@dataclass(frozen=True)
class Named(Query):
    """A label; the set is that of ``inner``."""

    inner: Query
    name: str
    expl: str = ""

    @property
    def children(self):
        return (self.inner,)

    def __str__(self):
        return self.name

    def explanation(self):
        return self.expl or self.inner.explanation()

    def desugared(self):
        return self.inner


@dataclass(frozen=True)
class Connected(Query):
    how: str
    inner: Query

    @property
    def children(self):
        return (self.inner,)

    def __str__(self):
        return f"{self.how}({self.inner})"

    def explanation(self):
        return f"{CONNECTIVES[self.how]} {self.inner.explanation()}"


@dataclass(frozen=True)
class Deeply(Query):
    """Objects of ``inner`` that can reach only objects of ``inner``."""

    inner: Query
    heap: bool = False

    @property
    def children(self):
        return (self.inner,)

    def __str__(self):
        return f"{'Heap' * self.heap}Deeply({self.inner})"

    def explanation(self):
        return f"{self.inner.explanation()}, and the same is true for all {'heap-' * self.heap}reachable objects"

    def desugared(self):
        return And((self.inner, Not(Connected("CanHeapReach" if self.heap else "CanReach", Not(self.inner)))))


def simplified(q: Query) -> Query:
    """An equal set in canonical form: sugar and labels are gone, double negation cancels against the universe of
    ``Not``, And/Or are flat, sorted and without repeats, closures are idempotent and distribute over Or."""
    while (plain := q.desugared()) != q:
        q = plain
    if isinstance(q, Not):
        inner = simplified(q.inner)
        return inner.inner if isinstance(inner, Not) and bounded(inner.inner) else Not(inner)
    if isinstance(q, And):
        flat: list[Query] = []
        for p in map(simplified, q.parts):
            flat += p.parts if type(p) is type(q) else (p,)
        parts = tuple(sorted(set(flat), key=str))
        return parts[0] if len(parts) == 1 else type(q)(parts)
    if isinstance(q, Connected):
        inner = simplified(q.inner)
        if q.how in CLOSURES:
            if isinstance(inner, Connected) and inner.how == q.how:
                return inner
            if isinstance(inner, Or):
                return simplified(Or(tuple(Connected(q.how, p) for p in inner.parts)))
        return Connected(q.how, inner)
    return q


def bounded(q: Query) -> bool:
    """Whether the set is known to lie in the universe of ``Not`` (traced ids above the JVM's)."""
    return isinstance(q, Not) or isinstance(q, Primitive) and q.name == "StackBoundObj" or isinstance(q, And) and type(q) is And and any(map(bounded, q.parts))


def negated(q: Query) -> Query:
    """``Not(Not(x))`` is written x, as the language defines it."""
    return q.inner if isinstance(q, Not) else Not(q)


def digest(q: Query) -> str:
    return hashlib.sha256(f"{SEMANTICS}:{simplified(q)}".encode()).hexdigest()


def dependency_tree(q: Query) -> str:
    """JSON: each query under its text, with the tree of its sub-queries."""
    tree = lambda x: {str(c): tree(c) for c in x.children}
    return json.dumps({str(q): tree(q)}, indent=2)


def primitive_queries(klass: str, site: tuple[str, int], extended: bool = False) -> list[Query]:
    """The queries of the warm-up grid; ``extended`` adds the stationary and the thread-local objects."""
    names = [n for n in PRIMITIVES if extended or n not in ("StationaryObj", "ThreadLocalObj")]
    return [*(Primitive(n) for n in names), InstanceOf(klass), AllocatedAt(*site)]


def wrapped(q: Query) -> list[Query]:
    """The query itself, its four closures and its two deep forms."""
    return [q, *(Connected(how, q) for how in ("CanReach", "CanHeapReach", "ReachableFrom", "HeapReachableFrom")), Deeply(q), Deeply(q, True)]


def series_of_queries(klass: str = "java.lang.String", site: tuple[str, int] = ("String.java", 1933)) -> list[Query]:
    """The warm-up grid: eleven queries, each in seven forms."""
    return [w for q in primitive_queries(klass, site) for w in wrapped(q)]
