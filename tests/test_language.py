import json

import pytest

from tracelens.functions.text import fixed, shorten
from tracelens.plans import ast
from tracelens.plans.parser import ParseError, escape, parse, unescape

TEXTS = [
    "MutableObj()", "InstanceOf(a.b.C$1)", "InstanceOf([Lx.Y;)", "AllocatedAt(String.java:1933)", "Set(-1 4 16)", "Not(Obj())",
    "And(Obj() UniqueObj() Or(TinyObj() Set(4)))", "CanHeapReach(ReferredFrom(StackBoundObj()))", "HeapDeeply(ImmutableObj())",
]


@pytest.mark.parametrize("text", TEXTS)
def test_text_round_trip(text):
    assert str(parse(text)) == text == str(parse(escape(text)))


@pytest.mark.parametrize("text", ["", "Foo()", "And(Obj())", "MutableObj() x", "Set()", "Not(Obj()", "AllocatedAt(x)"])
def test_rejects(text):
    with pytest.raises(ParseError):
        parse(text)


def test_escapes():
    assert unescape(escape("InstanceOf([I) x")) == "InstanceOf([I) x"


def test_rewrites():
    same = lambda a, b: ast.digest(parse(a)) == ast.digest(parse(b))
    assert same("Not(Not(MutableObj()))", "MutableObj()") and same("ImmutableObj()", "Not(MutableObj())")
    assert same("And(Obj() UniqueObj() Obj())", "And(UniqueObj() Obj())") and same("And(Obj() And(TinyObj() UniqueObj()))", "And(UniqueObj() Obj() TinyObj())")
    assert same("CanReach(CanReach(Obj()))", "CanReach(Obj())") and not same("CanReach(RefersTo(Obj()))", "CanReach(Obj())")
    assert same("CanReach(Or(Obj() TinyObj()))", "Or(CanReach(TinyObj()) CanReach(Obj()))") and not same("Deeply(Obj())", "HeapDeeply(Obj())")
    assert ast.digest(ast.Named(parse("Obj()"), "all")) == ast.digest(parse("Obj()"))


def test_explanations_and_tree():
    assert parse("Deeply(Not(MutableObj()))").explanation() == "not are changed outside their constructor, and the same is true for all reachable objects"
    assert json.loads(ast.dependency_tree(parse("And(Obj() Not(TinyObj()))"))) == {"And(Obj() Not(TinyObj()))": {"Obj()": {}, "Not(TinyObj())": {"TinyObj()": {}}}}


def test_grid():
    grid = ast.series_of_queries()
    assert len(grid) == len(set(map(str, grid))) == 77 and all(parse(str(q)) == q for q in grid)


def test_cells():
    assert shorten("x" * 40) == "x" * 14 + ".." + "x" * 14 and fixed("ab", 4) == "ab  "
