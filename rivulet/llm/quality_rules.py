"""Quality rules as a short-circuit cascade, in Spark SQL expressions only.

Each rule says when a document is rejected. On a small sample the operator
measures what each rule costs and how many documents it rejects, sorts the
rules by rejections per cost, and evaluates them as one chain of ``OR``,
which stops at the first rule that fires. The order changes the running time,
never the result.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import scratch_path
from rivulet.sources.files import Files

_WS = r"[\\x20\\x09-\\x0D]+"
_NON_WS = r"[^\\x20\\x09-\\x0D]"

#: Repeated windows: hashes settle that a text has none; only texts with an
#: equal hash pay for comparing the windows themselves. ``transform(array(x),
#: v -> ...)[0]`` binds x once, so nothing is evaluated again for each element.
#: ``array_distinct`` stands outside of any lambda, where it is compiled.
_HASHES = """transform(array(transform(_words, w -> xxhash64(w))), h -> transform(sequence(0, size(h) - 5),
    i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))[0]"""
_WINDOWS = """sort_array(transform(sequence(0, size(_words) - 5), i -> struct(
    concat_ws(' ', _words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]) AS g, i AS i)))"""
_POSITIONS = """sort_array(transform(filter(s, (x, k) ->
    (k > 0 AND s[greatest(k - 1, 0)].g = x.g) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].g = x.g)), x -> x.i))"""
_COVERED = """CASE WHEN size(p) = 0 THEN 0L ELSE 5L + aggregate(sequence(0, size(p) - 1), 0L,
    (acc, k) -> acc + CASE WHEN k = 0 THEN 0L ELSE CAST(least(5, p[k] - p[greatest(k - 1, 0)]) AS BIGINT) END) END"""

#: What rules may refer to, each computed from ``text`` and ``_words`` alone.
FEATURES = {
    "n_words": "CAST(size(_words) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join(_words, '')) AS BIGINT)",
    "n_symbols": "CAST(char_length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '')) AS BIGINT)",
    "n_upper": r"CAST(char_length(regexp_replace(coalesce(text, ''), '[^\\p{Lu}]+', '')) AS BIGINT)",
    "n_lines": f"CAST(size(filter(split(coalesce(text, ''), '\\n'), l -> l rlike '{_NON_WS}')) AS BIGINT)",
    "n_dup_lines": f"""transform(array(filter(split(coalesce(text, ''), '\\n'), l -> l rlike '{_NON_WS}')),
        v -> CAST(size(v) - size(array_distinct(v)) AS BIGINT))[0]""",
    "n_repeat_words": f"""CASE WHEN size(_words) < 6 THEN 0L WHEN size(array_distinct({_HASHES})) < size(_words) - 4
        THEN transform(array({_WINDOWS}), s -> transform(array({_POSITIONS}), p -> {_COVERED})[0])[0] ELSE 0L END""",
}
WORDS = f"array_remove(split(coalesce(text, ''), '{_WS}'), '')"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over the names in FEATURES."""

    name: str
    rejects: str
    base: bool = False


#: The first two are the base rules; the rest look for markup junk, repeated
#: lines, shouting, and texts whose words are far too short or too long.
RULES = (
    Rule("few_words", "n_words < 10", base=True),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", base=True),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_upper > 5 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)


def _inlined(condition: str, computed: tuple[str, ...] = ()) -> str:
    """The condition with every feature that is not a column replaced by its expression."""
    for i, name in enumerate(FEATURES):
        if name not in computed:
            condition = re.sub(rf"\b{name}\b", f"\0{i}\0", condition)
    for i, text in enumerate(FEATURES.values()):
        condition = condition.replace(f"\0{i}\0", f"({text})")
    return condition


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, repeats: int = 2) -> list[tuple[Rule, float, float]]:
    """Rules with (cost in seconds, share rejected) on a sample, best first.

    The sample is at most ``sample_rows`` documents of at most 100,000 bytes, read
    from as few partitions as hold them. It only decides the order of evaluation. A
    rule that rejects nothing in the sample comes last, the cheapest first;
    ties keep the given order.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).sample(0.2, seed=7)
    taken = texts.where("text IS NULL OR octet_length(text) < 100000").take(sample_rows)
    # as a file, because a table made of local rows would start Python workers on the executors
    spark = docs.sparkSession
    path = f"{scratch_path(spark, 'rule-sample')}/sample.json"
    Files(spark).create(path, "".join(json.dumps({"text": r["text"]}) + "\n" for r in taken))
    sample = spark.read.schema("text string").json(path).withColumn("_words", F.expr(WORDS))
    n = max(len(taken), 1)

    def timed(condition: str) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(repeats):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(F.expr(condition))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, rejected

    idle, _ = timed("size(_words) < 0")
    found = []
    for rule in rules:
        took, rejected = timed(_inlined(rule.rejects))
        found.append((rule, max(took - idle, 1e-3), rejected / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, features: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``failed_rule`` and ``kept``.

    ``features`` names what to return besides; such columns are then computed
    once for every document and the rules read them. Other features are
    evaluated only when the cascade reaches a rule that needs them.
    ``failed_rule`` is the first of ``rules``, as given, that rejects the document, whatever the
    order of evaluation was, so reruns agree; only rejected documents pay for that.
    Null and empty texts have no words, so ``few_words`` rejects them. Very long
    texts are judged whole. Columns
    of ``docs`` are returned as they are, save those with the names of new ones.
    Duplicate rows are judged alike; an empty table gives an empty result.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    new = {*features, "failed_rule", "kept", "_words", "_rejected"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    # explode() of one element is a barrier: a later filter on the verdict would otherwise
    # be moved below the words, which would then be split again for each use
    out = docs.select(*keep, F.explode(F.array(F.expr(WORDS))).alias("_words"))
    if features:
        out = out.select(*keep, "_words", *[F.expr(FEATURES[n]).alias(n) for n in features])

    rejected = " OR ".join(f"({_inlined(r.rejects, features)})" for r in ordered)  # OR stops at the first that fires
    first = " ".join(f"WHEN {_inlined(r.rejects, features)} THEN '{r.name}'" for r in rules)
    out = out.withColumn("_rejected", F.expr(f"coalesce({rejected}, false)")) if ordered else out.withColumn("_rejected", F.lit(False))
    out = out.withColumn("failed_rule", F.expr(f"CASE WHEN _rejected THEN CASE {first} END END") if ordered else F.lit(None).cast("string"))
    return out.withColumn("kept", ~F.col("_rejected")).drop("_words", "_rejected")
