"""License detection with ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.signatures import PRIORITY, ROOTS, SIGNATURES as OWN, root_of

GATE = "licen"  # every rule made of a name needs it

#: A label, a keyword that each of the names holds at the start of a word, and names that its licences go by, as
#: words in lower case. Names with no keyword in common have entries of their own under one label.
FAMILIES = [
    ("mit", "mit", "mit"), ("mit", "expat", "expat"), ("apache", "apache", "apache(?: software)?"),
    ("gpl", "gpl", "gnu gpl|gpl(?:v ?[123])?"), ("gpl", "general public", "(?:gnu )?general public"),
    ("lgpl", "lgpl", "gnu lgpl|lgpl(?:v ?[23])?"), ("lgpl", "lesser general public", "(?:gnu )?lesser general public"),
    ("lgpl", "library general public", "(?:gnu )?library general public"),
    ("agpl", "agpl", "gnu agpl|agpl(?:v ?3)?"), ("agpl", "affero general public", "(?:gnu )?affero general public"),
    ("gfdl", "gfdl", "gfdl"), ("gfdl", "free documentation", "(?:gnu )?free documentation"),
    ("bsd", "bsd", "(?:[0234] clause |modified |new |simplified |revised )?bsd(?: [0234] clause)?"),
    ("mpl", "mpl", "mpl"), ("mpl", "mozilla public", "mozilla public"), ("epl", "epl", "epl"), ("epl", "eclipse public", "eclipse public"),
    ("edl", "edl", "edl"), ("edl", "eclipse distribution", "eclipse distribution"), ("cpl", "cpl", "cpl"), ("cpl", "common public", "common public"),
    ("cddl", "cddl", "cddl"), ("cddl", "common development and distribution", "common development and distribution"),
    ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("libpng", "libpng", "libpng"), ("libpng", "png reference library", "png reference library"),
    ("unlicense", "unlicense", "the unlicense|unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the f", "do what the f[a-z]+ you want to public"),
    ("cc0", "cc0", "cc0(?: 1 0)?"), ("cc0", "creative commons zero", "creative commons zero"), ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-nd", "creative commons attribution non", "creative commons attribution non ?commercial no ?deriv[a-z]*"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-sa", "creative commons attribution non", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "cc by nc", "cc by nc"), ("cc-by-nc", "creative commons attribution non", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "cc by nd", "cc by nd"), ("cc-by-nd", "creative commons attribution no", "creative commons attribution no ?deriv[a-z]*"),
    ("cc-by-sa", "cc by sa", "cc by sa"), ("cc-by-sa", "creative commons attribution share", "creative commons attribution share ?alike"),
    ("cc-by", "cc by", "cc by"), ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("boost", "bsl 1 0", "bsl 1 0"), ("boost", "boost software", "boost software"), ("artistic", "artistic", "(?:perl )?artistic"),
    ("python", "psf", "psf"), ("python", "python", "python(?: software foundation)?"), ("php", "php", "php"), ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"), ("postgresql", "postgres", "postgresql|postgres"), ("ofl", "ofl", "ofl"),
    ("ofl", "open font", "(?:sil )?open font"), ("eupl", "eupl", "eupl"), ("eupl", "european union public", "european union public"),
    ("osl", "osl", "osl"), ("osl", "open software", "open software"), ("afl", "afl", "afl"), ("afl", "academic free", "academic free"),
    ("ms-pl", "ms pl", "ms pl"), ("ms-pl", "microsoft public", "microsoft public"), ("ms-rl", "ms rl", "ms rl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal"), ("ncsa", "ncsa", "ncsa|university of illinois ncsa open source"),
    ("upl", "upl", "upl"), ("upl", "universal permissive", "universal permissive"), ("vim", "vim", "vim"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?)?"), ("x11", "x11", "x11"), ("x11", "x consortium", "x consortium"),
    ("zpl", "zpl", "zpl"), ("zpl", "zope public", "zope public"), ("sleepycat", "sleepycat", "sleepycat"), ("beerware", "beer", "beer ?ware"),
    ("cecill", "cecill", "cecill(?: [abc])?"), ("json", "json", "json"), ("lppl", "lppl", "lppl"), ("lppl", "latex project public", "latex project public"),
    ("odbl", "odbl", "odbl"), ("odbl", "open database", "(?:open data commons )?open database"), ("odc-by", "odc by", "odc by"),
    ("odc-by", "open data commons attribution", "open data commons attribution"), ("pddl", "pddl", "pddl"),
    ("pddl", "public domain dedication and", "public domain dedication and"), ("nasa", "nasa", "nasa open source"), ("qpl", "qpl", "qpl"),
    ("qpl", "q public", "q public"), ("rpl", "rpl", "rpl"), ("rpl", "reciprocal public", "reciprocal public"), ("sspl", "sspl", "sspl"),
    ("sspl", "server side public", "server side public"), ("busl", "busl", "busl"), ("busl", "business source", "business source"),
    ("elastic", "elastic", "elastic"), ("proprietary", "proprietary", "proprietary"), ("proprietary", "commercial", "commercial"),
]

_VERSION = r"(?: version)?(?: v? ?[0-9]+(?: [0-9]+)?)?"
_TAIL = r"(?: or(?: at your option any)? later(?: versions?)?| only)?"
#: What says the name of a licence, by priority; a longer detection hides one in it of no more priority.
SIGNATURES = [
    ("identifier", 4, r"spdx licen[sc]e identifier (?:NAME)" + _VERSION + _TAIL),
    ("grant", 3, r"(?:re)?licensed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:NAME)(?: licen[sc]e)?" + _VERSION + _TAIL),
    ("terms", 3, r"(?:released|distributed|available|published|provided|shared|used) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:NAME) licen[sc]e" + _VERSION + _TAIL),
    ("field", 2, r"licen[sc]e (?:is )?(?:the )?(?:NAME)" + _VERSION + _TAIL),
    ("name", 1, r"(?:NAME) licen[sc]es?" + _VERSION + _TAIL),
]
WEIGHTS = {1: 0.6, 2: 0.7, 3: 0.9, 4: 1.0, 5: 1.0}  # what a detection of each priority says for the score; a base place says 0.5


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    keyword: str
    pattern: str


def _words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


@lru_cache(1)
def named_rules() -> tuple[Rule, ...]:
    """What says the name of a licence, for every name."""
    return tuple(
        Rule(label, kind, priority, keyword, _words(pattern.replace("NAME", names)))
        for kind, priority, pattern in SIGNATURES
        for label, keyword, names in FAMILIES
    )


@lru_cache(1)
def own_rules() -> tuple[Rule, ...]:
    """The signatures written one by one."""
    return tuple(
        Rule(label, kind, PRIORITY[kind], keyword.strip(), _words(pattern)) for label, each in OWN.items() for kind, keyword, pattern in each
    )


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """Every rule, highest priority first."""
    return tuple(sorted(named_rules() + own_rules(), key=lambda r: -r.priority))


def _by_root() -> Column:
    """The rules under the roots that open them: one root for all names, that of its keyword for each other rule."""
    named = set(named_rules())
    under = {root: [r for r in rules() if (GATE if r in named else root_of(r.keyword)) == root] for root in ROOTS}

    groups = [
        {"root": root, "rules": [{"pattern": r.pattern, "keyword": f" {r.keyword}", "priority": r.priority, "label": r.label} for r in some]}
        for root, some in under.items() if some
    ]
    kind = "array<struct<root string, rules array<struct<pattern string, keyword string, priority int, label string>>>>"
    return F.from_json(F.lit(json.dumps(groups)), kind)  # one constant; rules as columns of their own would take seconds to plan


def spaced(text: Column) -> Column:
    """The words of a text, in lower case and with a blank between two."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def base_places(words: Column) -> Column:
    """(start, label) wherever the words of a base phrase stand one after the other."""

    def place(word: Column, i: Column) -> Column:
        back = F.get(words, i - 1)
        found = (
            F.when(back == "mit", F.struct((i - 1).alias("start"), F.lit("mit").alias("label")))
            .when(back == "apache", F.struct((i - 1).alias("start"), F.lit("apache").alias("label")))
            .when((back == "public") & (F.get(words, i - 2) == "general"), F.struct((i - 2).alias("start"), F.lit("gpl").alias("label")))
        )
        return F.when(word == "license", found)

    return F.filter(F.transform(words, place), lambda x: x.isNotNull())


def _detections(text: Column, rule: Column) -> Column:
    """(start, end, priority, label) of all matches of a rule, in words; ``text`` has a blank before and after each word."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.slice(F.split(text, rule["pattern"], -1), F.lit(1), F.size(found))
    steps = F.zip_with(between, found, lambda b, m: F.struct(blanks(b).alias("gap"), blanks(m).alias("inner")))
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")

    def step(state: Column, x: Column) -> Column:
        start = (state["at"] + x["gap"] - 1).cast("int")
        hit = F.struct(
            start.alias("start"), (start + x["inner"]).cast("int").alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label")
        )
        return F.struct((state["at"] + x["gap"] + x["inner"]).cast("int").alias("at"), F.array_append(state["out"], hit).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).cast("int").alias("at"), empty.alias("out")), step, lambda s: s["out"])


def _survivors(found: Column) -> Column:
    """Labels and best priority of the detections that no earlier-sorted one of at least their priority contains."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                           .when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(b["priority"] - a["priority"]).cast("int"))
    tiers = sorted(WEIGHTS)
    zero = F.struct(
        *(F.lit(-1).cast("int").alias(f"m{p}") for p in tiers), F.lit(0).cast("int").alias("best"), F.array().cast("array<string>").alias("labels")
    )

    def step(s: Column, x: Column) -> Column:
        reach = F.lit(-1)
        for p in tiers:  # the farthest end among detections of at least this one's priority
            reach = F.greatest(reach, F.when(F.lit(p) >= x["priority"], s[f"m{p}"]).otherwise(F.lit(-1)))
        stays = reach < x["end"]
        ends = (F.when(x["priority"] == p, F.greatest(s[f"m{p}"], x["end"])).otherwise(s[f"m{p}"]).cast("int").alias(f"m{p}") for p in tiers)
        return F.struct(
            *ends,
            F.when(stays, F.greatest(s["best"], x["priority"])).otherwise(s["best"]).cast("int").alias("best"),
            F.when(stays, F.array_union(s["labels"], F.array(x["label"]))).otherwise(s["labels"]).alias("labels"),
        )

    return F.aggregate(ordered, zero, step, lambda s: F.struct(s["best"].alias("best"), s["labels"].alias("labels")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, base places and labels, all labels and a score.

    Each text is brought to words once. Those that hold a root go on, to the rules under the roots they hold; of these a
    rule is run on a text only if its keyword is in it. Detections are sorted by place, and one that lies within another of
    at least its priority is dropped. The score is that of the best detection that stays, 0.5 with base places alone, 0 with
    nothing.

    A null or empty text has no words. Very long texts are scanned whole, repeated rows alike. A null id is carried
    along. An empty table gives an empty result. Other columns are ignored. The plan has no shuffle and no join.
    """
    table = _by_root()
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced(F.col(text_col)).alias("s"))
    gated = words.select(
        "doc_id", F.when(F.col("s") == "", 0).otherwise(blanks(F.col("s")) + 1).cast("long").alias("n_words"),
        F.when(F.exists(table, lambda g: F.contains(F.col("s"), g["root"])), F.col("s")).alias("s"),
    )
    licence = F.when(F.contains("s", F.lit(GATE)), F.split("s", " "))
    split = gated.select("doc_id", "n_words", F.concat(F.lit(" "), "s", F.lit(" ")).alias("text"), licence.alias("words"))
    under = F.flatten(F.transform(F.filter(table, lambda g: F.contains(F.col("text"), g["root"])), lambda g: g["rules"]))
    active = F.filter(under, lambda r: F.contains(F.col("text"), r["keyword"]))
    found = F.when(F.col("text").isNotNull(), F.flatten(F.transform(active, lambda r: _detections(F.col("text"), r))))
    hits = split.select("doc_id", "n_words", base_places(F.col("words")).alias("base"), found.alias("found"))
    kept = hits.select("doc_id", "n_words", "base", _survivors(F.col("found")).alias("kept"))
    labels = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    nothing = F.array().cast("array<string>")
    own = F.coalesce(F.array_distinct(labels), nothing)
    score = F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    for priority, weight in sorted(WEIGHTS.items()):
        score = F.when(F.col("kept.best") == priority, F.lit(weight)).otherwise(score)
    return kept.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("kept.labels", nothing))), ",").alias("labels"),
        score.alias("score"),
    )
