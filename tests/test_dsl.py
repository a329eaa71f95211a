import pytest

from weftline.dsl import Mapper, ParseError, compile_pattern_body, parse_document, parse_graph, parse_pattern, pattern_to_dsl
from weftline.functions.values import Node
from weftline.plans.batch import find
from weftline.plans.pattern import Bind, Constraint, Is, Lit, Op, PatternBuilder, PatternError, Ref

HOSPITALITY = """
// a guest is harmed
pattern violation importance 2 {
  stage e1 { e1.eventType = "enterTown"  e1.actor -> ?guest }
  stage e2 { e2.eventType = "showHospitality"  e2.actor -> ?host  e2.target -> ?guest }
  stage e3 { e3.eventType = "harm"  e3.actor -> ?host  e3.target -> ?guest }
  unless between e1 e3 { mid.eventType = "leaveTown"  mid.actor -> ?guest }
  temporal e1 before e3 gap 1..
  deadline 5
  meta("kind", "old") meta("kind", "new")
}
graph {
  @1 ev1.eventType = "enterTown" @1 ev1.actor -> alice
  @2 ev2.eventType = "showHospitality" @2 ev2.actor -> bob @2 ev2.target -> alice
  @3..9 ev3.eventType = "harm" @3 ev3.actor -> bob @3 ev3.target -> alice
  now = 5
}
"""


def test_document(spark):
    d = parse_document(HOSPITALITY)
    p = d.patterns[0]
    assert (p.importance, p.deadline, dict(p.metadata)) == (2.0, 5, {"kind": "new"})
    assert (p.temporal[0].least, p.temporal[0].most) == (1.0, None)
    rows = find(d.graphs[0].build(spark), p).collect()
    assert [(r.guest.s, r.host.s) for r in rows] == [("alice", "bob")]


def test_round_trip():
    p = parse_document(HOSPITALITY).patterns[0]
    assert parse_pattern(pattern_to_dsl(p)) == p
    q = compile_pattern_body("q", 'stage a { a.x in [1, "b", true] a.y < 3.5 a.z -> ?v } let w = (?v + 1) * 2 stage b { b.y >= ?w ! b.tag = "no" ?v.trait = "x" } unless after a { m.k = ?v }')
    assert parse_pattern(pattern_to_dsl(q)) == q
    with pytest.raises(PatternError):
        pattern_to_dsl(PatternBuilder("p").stage("a").where("a", "x", "between", 1, 2).done().build())


def test_clauses_and_expressions():
    p = compile_pattern_body("p", 'stage a { a.t = "x" a.n -> ?v ! a.flag = true a.to -> bob } let z = ?v + 2 * 3 - 1')
    assert [c.target for c in p.stages[0].clauses] == [Is("x"), Bind("v"), Is(True), Is(Node("bob"))]
    assert p.stages[0].lets[0][1] == Op("-", Op("+", Ref("v"), Op("*", Lit(2.0), Lit(3.0))), Lit(1.0))
    assert compile_pattern_body("p", "stage a { a.n <= -4 }").stages[0].clauses[0].target == Constraint("<=", (-4.0,))
    assert compile_pattern_body("p", 'stage after { after.in = """a "b"\nc""" }').stages[0].clauses[0].target == Is('a "b"\nc')


def test_compose_and_templates():
    d = parse_document(
        """
        template strike(kind, who) { stage hit { hit.type = "kind" hit.actor -> who hit.by -> ?who } }
        pattern a { stage e { e.type = "a" e.actor -> ?c } }
        pattern b { instantiate strike("blow", "c") stage e { e.type = "b" e.actor -> ?c } }
        compose s = a >> b sharing(c)
        compose k = a | b
        compose n = a | b nonexclusive
        compose r = a * 3 sharing(c)
        compose l = a * 2..4 sharing(c)
        compose o = a * 2..
        private advance_in_place pattern z { concurrent { stage x { x.t = 1 x.k -> ?q } stage y { y.t = ?q } } }
        """
    )
    by = {p.name: p for p in d.patterns}
    assert [s.anchor for s in by["b"].stages] == ["inst1__hit", "e"]
    assert [c.target for c in by["b"].stages[0].clauses] == [Is("blow"), Is(Node("c")), Bind("c")]
    assert len(by["s"].stages) == 3 and by["s"].stages[0].clauses[1].target == Bind("c")
    assert (by["k_a"].group, by["n_a"].group) == ("k", None)
    assert len(by["r"].stages) == 3 and by["r"].loop is None
    assert (by["l"].loop.least, by["l"].loop.most, by["o"].loop.most) == (2, 4, None)
    assert by["z"].private and by["z"].advance_in_place and by["z"].unordered == ((0, 1),)


@pytest.mark.parametrize(
    "text",
    [
        "pattern p { stage a { ?x.y = 1 } }",
        "pattern p { stage a { a.y < ?x } }",
        "pattern p { stage a { a.y = 1 ! a.z < 2 } }",
        "pattern p { stage a { a.y = 1 ! a.z -> ?v } }",
        "pattern p { stage a { a.y -> ?a } }",
        "pattern p { stage a { ! a.y = 1 } }",
        "pattern p { stage a { a.y -> ?v } let v = 1 }",
        "pattern p { stage a { a.y = 1 } let v = ?w }",
        "pattern p { let v = 1 }",
        "pattern p { concurrent { stage a { a.y = 1 } } }",
        "pattern p { concurrent { stage a { a.y = 1 } stage b { b.y = 1 } } unless between a b { m.x = 1 } }",
        "pattern p { stage a { a.y = 1 } stage b { b.y = 1 } temporal a near b }",
        "pattern p { stage a { a.y = 1 } deadline 0 }",
        "private private pattern p { }",
        "pattern p { instantiate t() }",
        "template t(x) { stage a { a.y = 1 } } pattern p { instantiate t() }",
        "pattern a { stage e { e.y = 1 } } compose c = a * 0",
        "pattern a { stage e { e.y = 1 } } compose c = a * 3..2",
        "compose c = a >> b",
        'pattern p { stage a { a.y = "open } }',
        "pattern p { stage a { a.y = # } }",
        "stage a { }",
    ],
)
def test_errors(text):
    with pytest.raises(ParseError):
        parse_document(text)


def test_error_place_and_mapper():
    with pytest.raises(ParseError) as e:
        parse_document("pattern p {\n  stage a { a.y ~ 1 }\n}")
    assert (e.value.line, e.value.column) == (2, 17)

    class Coded(Mapper):
        def label(self, x):
            return f"l_{x}"

        def number(self, x):
            if x < 0:
                raise ValueError("negative")
            return x

    assert parse_pattern("pattern p { stage a { a.y = 1 } }", Coded()).stages[0].clauses[0].label == "l_y"
    with pytest.raises(ParseError):
        parse_pattern("pattern p { stage a { a.y = -1 } }", Coded())
    assert parse_graph("graph { @3 a.b = true now = 4 }").rows == [("a", "b", True, 3, None)]
