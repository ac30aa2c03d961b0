"""A threat counts with its target on either side."""

from factorspark.llm.toxicity import NEGATED, Grammar


def test_threat_order():
    g = Grammar({}, {})
    before, after = g.raw("you they kill"), g.raw("kill them")
    assert before == after > 0 and g.raw("I will kill you") == after
    assert g.raw("kill time") == 0 == g.raw("them")
    assert abs(g.clause("not kill you".split()) - NEGATED * g.clause("kill you".split())) < 1e-9
