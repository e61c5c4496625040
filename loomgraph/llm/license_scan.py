"""License scans with ordered signature rules, in DataFrame expressions only.

A prefilter over each text finds those with any licence keyword; only they are reduced to words. A rule runs where its
own keyword occurs. Its matches are intervals of the reduced text; of two overlapping detections the one of a stronger
rule stays, and a detection inside another one of no weaker rule goes (so `gnu general public license version 3` leaves no
bare `gpl`). Base phrases are found by themselves and always stay. No shuffle, no Python on the executors.

Defined cases: null text counts as empty: no words, no labels, null positions, score 0; an empty table gives an empty
result; ties between equal intervals go to the rule that stands first; repeated rows are each scanned; whole texts are
scanned; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import id_text
from loomgraph.llm.license_rules import rules

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Characters between words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every match of a rule or base phrase holds one of these strings, or `cc` before one of CC_FORMS.
KEYWORDS = "licens licenc spdx domain reserved permission commons unauthorized redistribution cc0 bsd unencumbered waived advertising perl holder attribution agreement remote gpl warranty proprietary".split()
CC_FORMS = rf"(?i)cc{GAP}+(?:by|zero|0|attribution)(?:{GAP}|\Z)"


def may_match(text: Column) -> Column:
    """Prefilter: false only where no rule and no base phrase can match."""
    lower = F.lower(text)
    out = lower.contains("cc") & text.rlike(CC_FORMS)
    for word in KEYWORDS:
        out = out | lower.contains(word)
    return out


def word_count(text: Column) -> Column:
    """Words: the pieces between gaps, without the empty ones before a first and behind a last gap."""
    edge = lambda at: F.substring(text, at, 1).rlike(GAP).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, rf"{GAP}+", -1)) - edge(1) - edge(-1)).cast("long")


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


#: A detection; in this order of fields, one that holds another comes before it, the stronger of equal ones first.
DETECTION = "struct<start: int, back: int, priority: int, ordinal: int, end: int, label: string, confidence: double>"


def intervals(text: Column, rule: Column) -> Column:
    """DETECTION of each match of a rule: one pass over the matches and what is between them."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    steps = F.filter(F.arrays_zip(F.split(text, rule["pattern"], -1).alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())

    def one(acc: Column, x: Column) -> Column:
        start = acc["upto"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        made = F.struct(start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["ordinal"].alias("ordinal"), end.alias("end"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        return F.struct(end.alias("upto"), F.array_append(acc["out"], made).alias("out"))

    nothing = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{DETECTION}>").alias("out"))
    return F.aggregate(steps, nothing, one, lambda acc: acc["out"])


def undefeated(found: Column, levels: list[int]) -> Column:
    """Detections that no other takes the place of, in two passes over their order.

    A detection goes if one of no weaker rule holds it, or if one of a stronger rule (of a lower priority number) overlaps it. Going
    forward, it is enough to know how far the detections of each level of priority reach; going back, where the first starts.
    """

    def forward(acc: Column, d: Column) -> Column:
        far = acc["far"]
        lost = F.lit(False)
        for k, p in enumerate(levels):
            lost = lost | ((F.lit(p) <= d["priority"]) & (far[k] >= d["end"])) | ((F.lit(p) < d["priority"]) & (far[k] > d["start"]))
        moved = F.array(*[F.when(d["priority"] == p, F.greatest(far[k], d["end"])).otherwise(far[k]) for k, p in enumerate(levels)])
        return F.struct(moved.alias("far"), F.array_append(acc["out"], F.struct(d.alias("d"), lost.alias("lost"))).alias("out"))

    def back(acc: Column, x: Column) -> Column:
        near, d = acc["near"], x["d"]
        lost = x["lost"]
        for k, p in enumerate(levels):
            lost = lost | ((F.lit(p) < d["priority"]) & (near[k] < d["end"]))
        moved = F.array(*[F.when(d["priority"] == p, F.least(near[k], d["start"])).otherwise(near[k]) for k, p in enumerate(levels)])
        return F.struct(moved.alias("near"), F.when(lost, acc["out"]).otherwise(F.array_append(acc["out"], d)).alias("out"))

    one = F.array_sort(found)
    first = F.struct(F.array(*[F.lit(-1)] * len(levels)).alias("far"), F.array().cast(f"array<struct<d: {DETECTION}, lost: boolean>>").alias("out"))
    last = F.struct(F.array(*[F.lit((1 << 31) - 1)] * len(levels)).alias("near"), F.array().cast(f"array<{DETECTION}>").alias("out"))
    return F.aggregate(F.reverse(F.aggregate(one, first, forward, lambda acc: acc["out"])), last, back, lambda acc: acc["out"])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row."""
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(i).alias("ordinal"), F.lit(r.confidence).alias("confidence")) for i, r in enumerate(rules())])
    rows = id_text(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), rf"{GAP}+", " "))
    rows = rows.select("doc_id", word_count(F.col("text")).alias("n_words"), F.when(may_match(F.col("text")), F.concat(F.lit(" "), words, F.lit(" "))).alias("reduced"))
    reduced = F.col("reduced")
    rows = rows.select(
        "doc_id", "n_words",
        *[F.split(reduced, rf"(?<= ){phrase}(?= )", -1).alias(f"p{i}") for i, (phrase, _) in enumerate(BASE)],
        F.when(reduced.isNotNull(), F.flatten(F.transform(F.filter(table, lambda r: reduced.contains(r["keyword"])), lambda r: intervals(reduced, r)))).alias("found"),
    )
    count = [F.coalesce(F.size(f"p{i}") - 1, F.lit(0)) for i in range(len(BASE))]
    count = [F.greatest(c, F.lit(0)) for c in count]
    firsts = [F.when(c > 0, spaces(F.element_at(f"p{i}", 1)) - 1) for i, c in enumerate(count)]
    lasts = [F.when(c > 0, F.col("n_words") - (spaces(F.element_at(f"p{i}", -1)) - 1) - len(BASE[i][0].split())) for i, c in enumerate(count)]
    base = F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(count, BASE, strict=True)]), lambda x: x.isNotNull())
    found = F.col("found")
    rows = rows.select(
        "doc_id", "n_words",
        sum(count[1:], count[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        base.alias("base"),
        F.when(F.size(found) > 0, undefeated(found, sorted({r.priority for r in rules()}))).otherwise(F.array().cast(f"array<{DETECTION}>")).alias("kept"),
    )
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    best = F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
        F.size("kept").cast("long").alias("n_detections"),
    )
