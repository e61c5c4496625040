import random
import re

from pyspark.sql import functions as F

from loomgraph.llm.license_rules import LICENSES, rules
from loomgraph.llm.license_scan import BASE, CC_FORMS, KEYWORDS, may_match, scan_licenses

SCHEMA = "doc_id long, text string, labels string"


def brute(text):
    """The same by plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, len(p.split()), label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    reduced = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), k, r) for k, r in enumerate(rules()) for m in re.finditer(r.pattern, reduced)]

    def beats(e, d):
        inside, same = e[0] <= d[0] and e[1] >= d[1], e[:2] == d[:2]
        if same:
            return (e[3].priority, e[2]) < (d[3].priority, d[2])
        if inside:
            return e[3].priority <= d[3].priority
        return e[0] < d[1] and d[0] < e[1] and e[3].priority < d[3].priority

    kept = [d for d in found if not any(beats(e, d) for e in found)]
    base = sorted({p[2] for p in places})
    labels = sorted({*base, *(d[3].label for d in kept)})
    score = 1.0 if places else max((d[3].confidence for d in kept), default=0.0)
    starts = [p[0] for p in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, len(kept))


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in scan_licenses(df).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc\nby\tnc", "GNU General Public License v3", "released under the LGPL license", "licensed under the MPL 2.0", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "creative commons attribution share alike 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy", "the", "é日本", "word", "--", "is in the public domain", "Under The Mit", "license", "under the mit license under the mit license"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) + rng.choice(["", " ", ".", "\n"]) for _ in range(150)]
    texts += [None, "", " ", "...", "a", "-a-", "KKelvin license", "x " * 50_000 + "under the mit license"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t, got[i], brute(t))


def test_prefilter_lets_every_rule_pass(spark):
    """Some keyword of the prefilter stands in each literal part of every rule."""
    for r in rules():
        text = re.sub(r"\(\?<= \)|\(\?= \)", "", r.pattern).replace("[sc]", "s")
        assert any(k in text for k in KEYWORDS) or "cc" in text, r


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    assert re.search(CC_FORMS, "CC  BY-NC")


def forms(parsed):
    """The texts of a parsed pattern: each alternative, each optional part with and without, each letter of a class."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "IN":
            more = [chr(a) if str(k) == "LITERAL" else "s" if str(k) == "CATEGORY" else chr(a[0]) for k, a in arg]
        elif kind == "BRANCH":
            more = [x for branch in arg[1] for x in forms(branch)]
        elif kind == "SUBPATTERN":
            more = forms(arg[3])
        elif kind == "MAX_REPEAT":
            more = ([""] if arg[0] == 0 else []) + forms(arg[2])
        else:
            raise ValueError(kind)
        out = [a + b for a in out for b in more]
    return out


def test_prefilter_lets_each_alternative_pass_alone(spark):
    parts = [x for _, _, name, _, sentence in LICENSES for x in (name, sentence) if x] + [p for p, _ in BASE]
    texts = sorted({t for p in parts for t in forms(re._parser.parse(p))})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in df.filter(~may_match(F.col("text"))).collect()] == []


def test_notices_that_stand_alone(spark):
    texts = ["This file is proprietary and confidential.", "cc zero", "CC-0", "see CC 0.", "cc by"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert got[0][5] == "proprietary" and got[1][5] == got[2][5] == "cc0"


def test_thousands_of_notices_in_one_text(spark):
    line = "Licensed under the MIT License. SPDX-License-Identifier: Apache-2.0; see CC BY-NC 4.0 and the GNU General Public License version 3. "
    rows = [(1, line * 1000), (2, "released as cc zero"), (3, "dedicated by cc 0")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_detections >= 3000 and {"mit", "cc-by-nc"} <= set(got[1].labels.split(","))
    assert got[2].labels == got[3].labels == "cc0"
