import re

from reelgraph.llm import licenses
from tests.llm import data

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [(r, re.compile(r.pattern)) for r in licenses.rules()]


def plain(text):
    words = WORDS.findall((text or "").translate(LOWER))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    joined = f" {' '.join(words)} "
    found = []
    for r, pattern in RULES:
        for m in pattern.finditer(joined):  # no gate at all
            start = joined.count(" ", 0, m.start()) - 1
            found.append((start, start + m.group().count(" "), r.priority, r.label))
    found.sort(key=lambda x: (x[0], -x[1], -x[2]))
    kept = [x for k, x in enumerate(found) if not any(y[1] >= x[1] and y[2] >= x[2] for y in found[:k])]
    base = {label for _, label in places}
    best = max((x[2] for x in kept), default=0)
    starts = [i for i, _ in places]
    score = licenses.WEIGHTS[best] if best else 0.5 if places else 0.0
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x[3] for x in kept})), score,
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0 or later", "SPDX-License-Identifier: GPL-3.0-only", "the MIT mit license license",
    "general public license, GNU General Public License v2; lesser general public license", "License: BSD 3-Clause",
    "Released under CC BY-NC 4.0 license. MIT LICENSE mit license", "licensed under the terms of the Mozilla Public License version 1.1",
    "This licence is the W3C Software License", "mıt license", "MIT_License", "a license", "license mit license",
]


def check(spark, rows):
    got = sorted((tuple(r) for r in licenses.scan(data.documents(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_odd_documents(spark):
    check(spark, data.texts() + list(enumerate(TEXTS, 100)))
    assert licenses.scan(data.documents(spark, [])).count() == 0


def test_small_table(spark):
    check(spark, data.pairs(spark))


def test_hundreds_of_rules_and_no_python(spark):
    assert len(licenses.rules()) > 200
    assert [r.priority for r in licenses.rules()] == sorted((r.priority for r in licenses.rules()), reverse=True)
    plan = licenses.scan(data.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Join" not in plan


def test_containment():
    assert plain("licensed under the apache license version 2 0")[5:] == ("apache", 0.9)
    assert plain("gnu lesser general public license")[5] == "gpl,lgpl"
