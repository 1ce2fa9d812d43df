import re

from reelgraph.llm import licenses
from tests.llm import data

NAMED = [
    ("X Consortium license", "x11"), ("released under the Expat license", "mit"), ("PNG Reference Library License", "libpng"),
    ("Do What The Fuck You Want To Public License", "wtfpl"), ("a commercial license", "proprietary"),
    ("Creative Commons Attribution NonCommercial ShareAlike license", "cc-by-nc-sa"), ("CC BY-NC-ND license", "cc-by-nc-nd"),
    ("Creative Commons Attribution NonCommercial NoDerivatives license", "cc-by-nc-nd"), ("libpng license", "libpng"),
]


def test_names_without_the_other_names_keyword(spark):
    rows = [(k, t) for k, (t, _) in enumerate(NAMED)]
    got = {r["doc_id"]: r for r in licenses.scan(data.documents(spark, rows)).collect()}
    for k, (_, label) in enumerate(NAMED):
        assert label in got[k]["labels"].split(",") and got[k]["score"] > 0


def names(pattern):
    """Each alternative of a family, with its optional parts left out and put in."""
    for part in re.split(r"\|(?![^(]*\))", pattern):
        inner = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"(?:\1)", part).replace("[a-z]+", "uck").replace("[a-z]*", "").replace("[123]", "2")
        inner = re.sub(r"\[[^]]*([0-9a-z])\]", r"\1", inner)
        yield re.sub(r" \?", "", re.sub(r"\(\?:[^()]*\)\?|[a-z ]\?", "", inner)).replace("(?:", "").replace(")", "")
        yield inner.replace("(?:", "").replace(")", "").replace("?", "")


def test_every_match_opens_its_gates():
    """Every pattern ungated, over every form of every name: what matches holds the rule's keyword and the gate."""
    forms = [" ".join(n.split()) for _, _, pattern in licenses.FAMILIES for n in names(pattern)]
    texts = [f" spdx license identifier {n} x licensed under the {n} license x released under {n} licence x license is {n} " for n in forms]
    matched = set()
    for r in licenses.named_rules():
        for text in texts:
            for m in re.finditer(r.pattern, text):
                matched.add(r)
                assert r.keyword in m.group() and licenses.GATE in m.group(), (r, m.group())
    assert matched == set(licenses.named_rules())
