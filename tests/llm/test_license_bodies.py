"""Signatures written one by one: every form of each opens its gates, and whole notices give their labels."""

import itertools
import re

import pytest

from reelgraph.llm import licenses, signatures
from tests.llm import data
from tests.llm.test_licenses import check, plain

NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "public-domain": "He released it into the public domain; this is released into the public domain",
    "openssl": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "wtfpl": "0. You just DO WHAT THE FUCK YOU WANT TO.",
    "cc-by-sa": "https://creativecommons.org/licenses/by-sa/4.0/",
    "cc0": "CC0 1.0 Universal",
    "lgpl": "(C) me, LGPLv2.1+",
}
SHORT = {"GPLv3": "gpl", "Apache-2.0": "apache", "BSD-3-Clause": "bsd", "SPDX-License-Identifier: ISC": "isc", "AGPL-3.0": "agpl"}


def forms(tokens) -> list[str]:
    """Every form of a parsed pattern: options out and in, each branch, the first of a set of characters."""
    out = [""]
    for op, value in tokens:
        name = str(op)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "NOT_LITERAL":
            some = ["n"]
        elif name == "IN":
            kind, first = value[0]
            some = [chr(first if str(kind) == "LITERAL" else first[0])]
            some = ["n"] if str(kind) == "NEGATE" else some
        elif name == "BRANCH":
            some = [f for part in value[1] for f in forms(part)]
        elif name == "SUBPATTERN":
            some = forms(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            some = [f for n in {low, min(int(high), low + 1)} for f in ("".join(x) for x in itertools.product(forms(inner), repeat=n))]
        else:
            assert name in ("ASSERT", "AT", "ASSERT_NOT"), name
            continue
        out = [a + b for a in out for b in some]
    return out


def parsed(rule):
    return forms(re._parser.parse(rule.pattern))


def test_every_form_of_a_signature_opens_its_gates():
    own = licenses.own_rules()
    assert len(own) >= 200 and len(set(own)) == len(own)
    for r in own:
        root = signatures.root_of(r.keyword)
        assert len(r.keyword) >= 3 and root in r.keyword
        for form in parsed(r):
            assert re.fullmatch(r.pattern.replace("(?<= )", "").replace("(?= )", ""), form), (r, form)
            assert f" {r.keyword}" in f" {form}", (r, form)


def test_every_signature_is_found(spark):
    """One text for each rule, a long form in it; the plan's result equals that of all rules without gates."""
    rows = [(k, f"Some words, {max(parsed(r), key=len).upper()}. More words") for k, r in enumerate(licenses.own_rules())]
    check(spark, rows)
    for (_, text), r in zip(rows, licenses.own_rules(), strict=True):
        assert plain(text)[6] > 0, r


@pytest.mark.parametrize(("label", "text"), [*NOTICES.items(), *((v, k) for k, v in SHORT.items())])
def test_notices(label, text):
    assert label in plain(text)[5].split(",") and plain(text)[6] >= 0.7


def test_notices_on_spark(spark):
    texts = [*NOTICES.values(), *SHORT, " ".join([data.prose(3000, 3), *NOTICES.values(), data.prose(3000, 4)])]
    check(spark, list(enumerate(texts)))
