"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
counts of vote patterns estimates, without labels, the share of good documents and each rule's two
accuracies: how often its vote on a good document is good, and on a bad one bad. The posterior log-odds of
good are the prior's plus each vote's log likelihood ratio under these. A document is kept if the base checks pass and its posterior is
at least a half; no rule is a must-pass.

Only DataFrame functions run on the executors. Documents are reduced, with map-side sums, to at most
3 ** len(RULES) pattern counts; each EM step is one aggregate over that table that returns one row of
sums. Repeated windows are found inside a row by sorting their hashes, so a text of n
words costs n log n and nothing of it is shuffled.

Defined results: a null or empty text has zeros and fails the base check; repeated rows each come back and count
each; a window is known by a 64-bit hash of its five words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

STEPS = 10
# Starting values: share of good documents, accuracy on good and on bad ones; and the accuracies' limits.
PRIOR, GOOD, BAD = 0.9, 0.99, 0.4
LEAST, MOST = 0.1, 0.999
ENDS = r"[#*$%&|<>!]+([\x20\x09-\x0D]|\z)"
DOUBLED = r"[#*$%&|<>!]{2,}"
# name -> SQL of the vote over the base counts, the same in Spark and DuckDB.
RULES = {
    "symbols": "case when 5 * n_symbols > n_words then -1 when 50 * n_symbols <= n_words then 1 else 0 end",
    "endings": "case when 5 * n_ends > n_words then -1 when 20 * n_ends <= n_words then 1 else 0 end",
    "doubled": "case when 10 * n_doubled > n_words then -1 when 50 * n_doubled <= n_words then 1 else 0 end",
    "repeats": "case when 10 * n_repeat_words > n_words then -1 when n_repeat_words = 0 and n_words >= 20 then 1 else 0 end",
    "lines": "case when n_dup_lines >= 3 and 5 * n_dup_lines >= n_lines then -1 when n_dup_lines = 0 and n_lines >= 3 then 1 else 0 end",
    "capitals": "case when 2 * n_upper > word_chars then -1 when 5 * n_upper < word_chars then 1 else 0 end",
    "lengths": "case when word_chars > 15 * n_words or word_chars < 2 * n_words then -1 when word_chars <= 10 * n_words and word_chars >= 3 * n_words then 1 else 0 end",
    "variety": "case when n_words < 30 then 0 when 5 * n_distinct < n_words then -1 when 2 * n_distinct > n_words then 1 else 0 end",
    "size": "case when n_words >= 50 then 1 else 0 end",
}


def let(value, body):
    """body(value) with the value computed once a row, however often a lambda in the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words):
    """Words inside five-word windows that occur twice or more, of an array of words."""
    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    def covered(h):
        def at(s):
            def twice(j):
                own = F.get(s, j)["h"]
                return F.when(own.eqNullSafe(F.get(s, j - 1)["h"]) | own.eqNullSafe(F.get(s, j + 1)["h"]), F.get(s, j)["i"])
            return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda x: x.isNotNull()))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(pairs, at)
        steps = let(starts, lambda q: F.transform(q, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(q, k + 1) - x, F.lit(5)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(let(words, hashes), covered)).cast("long")


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(F.col("text"), F.lit(C.SPACE_CHARS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_.alias("text"))
    rows = rows.withColumn("words", F.when(F.length(trimmed) > 0, F.split(trimmed, C.SPACE)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(C.SPACE_CHARS))) > 0))

    def less(pattern):
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), less(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), less("[A-Z]+").alias("n_upper"), F.regexp_count("text", F.lit(ENDS)).cast("long").alias("n_ends"), F.regexp_count("text", F.lit(DOUBLED)).cast("long").alias("n_doubled"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def _held(value: float) -> float:
    return min(max(value, LEAST), MOST)


def fit(votes: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of good, each rule's accuracies on good and on bad) after STEPS rounds of expectation-maximisation."""
    patterns = C.written(votes.groupBy(*RULES).agg(F.count("*").alias("n")), "patterns")
    prior, accuracy = PRIOR, dict.fromkeys(RULES, (GOOD, BAD))
    for _ in range(STEPS):
        good = posterior(prior, accuracy)
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * good).alias("good")]
        for name in RULES:
            up, down = F.col(name) > 0, F.col(name) < 0
            for key, test, weight in (("gg", up, good), ("gb", down, good), ("bb", down, 1 - good), ("bg", up, 1 - good)):
                sums.append(F.sum(F.when(test, F.col("n") * weight).otherwise(0.0)).alias(f"{key}_{name}"))
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        prior = _held(row["good"] / row["all"])
        accuracy = {name: (_held((row["gg_" + name] + GOOD) / (row["gg_" + name] + row["gb_" + name] + 1)),
                           _held((row["bb_" + name] + BAD) / (row["bb_" + name] + row["bg_" + name] + 1))) for name in RULES}
    return prior, accuracy


def posterior(prior: float, accuracy: dict[str, tuple[float, float]]):
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in accuracy.items():
        odds = odds + F.when(F.col(name) > 0, F.lit(math.log(good / (1 - bad)))).when(F.col(name) < 0, F.lit(math.log((1 - good) / bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, quality (posterior), kept."""
    counts = base_counts(docs, doc_id, text)
    voted = C.written(counts.select("*", *(F.expr(sql).alias(name) for name, sql in RULES.items())), "votes")
    prior, accuracy = fit(voted)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("quality", posterior(prior, accuracy)).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), F.round("quality", 4).alias("quality"))


def oracle() -> str:
    """The same in DuckDB, with the EM steps as one common table expression each."""
    names = list(RULES)
    z = "ln(p.prior / (1 - p.prior))" + "".join(f" + case when {n} > 0 then ln(p.{n}_g / (1 - p.{n}_b)) when {n} < 0 then ln((1 - p.{n}_g) / p.{n}_b) else 0 end" for n in names)

    def held(x):
        return f"least(greatest({x}, {LEAST}), {MOST})"

    def total(n, sign, weight):
        return f"sum(case when {n} {sign} 0 then n * {weight} else 0.0 end)"

    steps, last = [], "e0"
    for k in range(1, STEPS + 1):
        cols = [held("sum(n * g) / sum(n)") + " prior"]
        for n in names:
            cols.append(held(f"({total(n, '>', 'g')} + {GOOD}) / ({total(n, '>', 'g')} + {total(n, '<', 'g')} + 1)") + f" {n}_g")
            cols.append(held(f"({total(n, '<', '(1 - g)')} + {BAD}) / ({total(n, '<', '(1 - g)')} + {total(n, '>', '(1 - g)')} + 1)") + f" {n}_b")
        steps.append(f"e{k} as (select {', '.join(cols)} from (select pat.*, 1 / (1 + exp(-({z}))) g from pat, {last} p))")
        last = f"e{k}"
    ws = r"\x20\x09-\x0D"
    return rf"""
with recursive t as (select doc_id, coalesce(text, '') text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^{ws}]+') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{ws}]')) l from t),
win as (select doc_id, i, array_to_string(w[i:i+4], ' ') k from w, unnest(range(1, len(w) - 3)) u(i)),
dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
cov as (select doc_id, count(distinct i + o) n from dup, unnest(range(5)) u(o) group by doc_id),
b as (select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, len(l) n_lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) n_upper, len(regexp_extract_all(text, '{ENDS}')) n_ends, len(regexp_extract_all(text, '{DOUBLED}')) n_doubled, len(list_distinct(w)) n_distinct
  from w left join cov on cov.doc_id = w.doc_id),
v as (select *, {', '.join(f'{sql} {n}' for n, sql in RULES.items())} from b),
pat as (select {', '.join(names)}, count(*) n from v group by all),
e0 as (select {PRIOR}::double prior, {', '.join(f'{GOOD}::double {n}_g, {BAD}::double {n}_b' for n in names)}),
{', '.join(steps)},
q as (select v.*, 1 / (1 + exp(-({z}))) quality from v, {last} p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)) and quality >= 0.5 kept, round(quality, 4) quality from q
"""
