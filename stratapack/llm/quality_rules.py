"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost and its share of rejected rows are measured on a sample of about SAMPLE rows.  The rules are then nested
(CASE WHEN) by falling rejection per cost, so a text that an early rule rejects doesn't pay for the later ones.
The order changes the cost, never the verdict: a text is kept if no rule rejects it.

The cost of a rule is the time of a job that judges every sampled row REPEATS times, less that of the same job with a rule that looks at nothing.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: Rows on which costs and selectivities are estimated: about so many, each chosen by itself, and twice as many at most.
SAMPLE = 1000
#: How often each sampled row is judged by each rule for its cost, and how many runs there are, of which the fastest counts.
REPEATS, RUNS = 8, 2
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`rejects` gives a boolean Column, never null, of the text and of the columns that measures() adds."""

    name: str
    rejects: Column
    cost: float = 0.0
    selectivity: float = 0.0


def _let(value: Column, body) -> Column:
    """`body` of `value`, evaluated once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of `size` words that the text has twice or more."""

    def spread(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = _let(ranked, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        own = _let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    wins = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size))))
    found = _let(wins, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("bigint")).otherwise(spread(win)))
    return F.when(F.size(w) < size, F.lit(0).cast("bigint")).otherwise(found)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, of the whole text (null: empty)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = _let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    m = free_name("m", docs.columns)
    out = docs.withColumns(
        {
            m: made,
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        }
    )
    out = out.withColumns({c: F.col(f"{m}.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop(m)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules beyond the base; they spare ordinary prose."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") > 20 * n) | (2 * F.col("word_chars") < 3 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.size(F.split(t, "\n"))),
        Rule("letters", 2 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < F.col("word_chars")),
    ]


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules with their cost (seconds a row, without the job's own) and selectivity on a sample of `docs`, by falling rejection per cost."""
    total = docs.count()
    if not total:
        return rules
    few = docs.select(text) if total <= sample else docs.select(text).sample(sample / total, seed=17).limit(2 * sample)
    few = measures(few, text).repartition(1).cache()  # a task: SAMPLE rows
    n = max(1, few.count())
    again = few.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(rejects: Column) -> tuple[float, int]:
        took, rejected = [], 0
        for _ in range(RUNS):  # the first run compiles
            began = time.perf_counter()
            rejected = again.agg(F.coalesce(F.sum(rejects.cast("bigint")), F.lit(0))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took) / n / REPEATS, rejected // REPEATS

    nothing, _ = run(F.col("n_words") < 0)
    out = []
    for rule in rules:
        cost, rejected = run(rule.rejects)
        out.append(Rule(rule.name, rule.rejects, max(cost - nothing, 1e-9), rejected / n))
    few.unpersist()
    return sorted(out, key=lambda r: -r.selectivity / r.cost)


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules aren't evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """`docs` with the measures, base_failed, kept, and rejected_by: 'base' or the rule that rejected first (null if kept).

    Null and empty texts have no words and fail the base.  Very long texts are judged whole.  Repeated rows are judged alike.  Input columns with the names of made ones are
    replaced, all others pass unchanged.  `rules` look at the text and the measures only.  An empty table gives an empty table.
    """
    measured = measures(docs, text)
    ordered = estimate(docs, rules if rules is not None else standard_rules(text), text, sample)
    out = measured.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id IS NOT DISTINCT FROM rep.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > len(string_split(t, chr(10)))
            OR 2 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < word_chars) AS kept
FROM b
"""
