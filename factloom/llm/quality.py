"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Features of each whole text are taken once. Every rule has a ladder of cutoffs from lax to strict, fixed
beforehand; a document is rejected if its value is over the rule's cutoff for its stratum (a length class).
Cutoffs are chosen on the labelled holdout: going down a rule's ladder in a stratum, the hypothesis "this
cutoff rejects more than risk / rules of the good documents" is tested by the exact binomial tail of the good
documents it rejects, at level error / (rules x strata), until one stands. The last cutoff before it is taken; if
the first stands, the rule is off there. So with probability 1 - error no stratum loses more than `risk` of its
good documents (fixed-sequence testing on each ladder, Bonferroni over ladders, union bound over rules).

Even with no good document rejected, a cutoff passes only if (1 - risk / rules) ** n <= error / (rules x strata): with the
defaults (0.995 ** n <= 0.05 / 16) n >= 1151 good labelled documents are needed. A stratum with fewer is tested together
with its neighbours, one more on each side until there are enough; the bound then holds for these strata in all. Where
even all strata have fewer, every rule is off and `kept` is just not base_failed.

Cases: a null or empty text has no words and fails the base rule. A document is good if it has a label of quality 1 and
none of 0; it is one trial however often it or its label is repeated (of rows that share a doc_id, the one with the
most words, then the greatest other features). Near copies under other ids are trials of their own, so a holdout should be
drawn after dedup. Labels without a document and null labels do not count; repeated rows are judged alike; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, let, staged

SYMBOLS = "#*$%&|<>"
#: Value of a rule over the features, and its cutoffs from lax to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
}
#: Lower bounds of the length classes, in words.
STRATA = (0, 150, 400, 1500)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in words (an array).

    Windows are compared by a 64-bit hash of their words within one text.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        alike = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        starts = let(placed, lambda s: F.filter(s, lambda x, i: F.when(i > 0, alike(s, x, i - 1)).otherwise(F.lit(False)) | alike(s, x, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(F.col("n_words") >= least, F.lit(k)).otherwise(out)
    return out


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), in logarithms; 1 where k is not below the mean (no test could pass there)."""
    ratio = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + ratio
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    summed = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: F.exp(acc["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(summed)


def least_trials(risk: float = 0.02, error: float = 0.05) -> int:
    """Good documents that a test needs before it can pass at all."""
    return math.ceil(math.log(error / (len(RULES) * len(STRATA))) / math.log(1 - risk / len(RULES)))


def pooled(per: DataFrame, least: int) -> DataFrame:
    """Counts (stratum, n, rules) with those of neighbouring strata added until n is at least `least`: a row a stratum.

    Strata that have too few even together are left out. Both sides of the join have len(STRATA) rows at most.
    """
    wide = F.explode(F.sequence(F.lit(0), F.lit(len(STRATA) - 1)))
    around = per.sparkSession.range(len(STRATA)).select(F.col("id").cast("int").alias("to")).select("to", wide.alias("radius"))
    met = around.join(F.broadcast(per), F.abs(F.col("to") - F.col("stratum")) <= F.col("radius"))
    summed = [F.array(*(F.sum(F.get(rule, F.lit(k))) for k in range(len(ladder)))).alias(rule) for rule, (_, ladder) in RULES.items()]
    sums = met.groupBy("to", "radius").agg(F.sum("n").alias("n"), *summed).where(F.col("n") >= least)
    columns = ["n", *RULES]
    first = sums.groupBy("to").agg(F.min_by(F.struct(*columns), "radius").alias("c"))
    return first.select(F.col("to").alias("stratum"), *(F.col(f"c.{c}").alias(c) for c in columns))


def trials(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of good labelled documents that pass the base rule: one row a doc_id."""
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("best")).where("q = 1 and best = 1")
    order = ["n_words", *(c for c in rows.columns if c not in ("doc_id", "n_words"))]
    met = rows.where(~base_failed()).join(good.select("doc_id"), "doc_id")
    return met.groupBy("doc_id").agg(F.max(F.struct(*order)).alias("f")).select("doc_id", "f.*")


def thresholds(good: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, and for each rule its cutoff or null) from the features of good labelled documents.

    The result has a row a stratum at most: len(STRATA) by construction.
    """
    counts = [F.count("*").alias("n")]
    for rule, (value, ladder) in RULES.items():
        counts.append(F.array(*(F.count_if(F.expr(value) > F.lit(c)) for c in ladder)).alias(rule))
    per = pooled(good.withColumn("stratum", stratum()).groupBy("stratum").agg(*counts), least_trials(risk, error))
    level = error / (len(RULES) * len(STRATA))
    out = []
    for rule, (_, ladder) in RULES.items():
        passes = F.transform(F.col(rule), lambda k: binomial_tail(F.col("n"), k, risk / len(RULES)) <= level)
        cutoffs = F.array(*(F.lit(c) for c in ladder))
        # How many pass before the first that does not.
        run = let(passes, lambda p: F.coalesce(F.nullif(F.array_position(p, False), F.lit(0).cast("long")), F.size(p) + 1) - 1)
        out.append(let(run, lambda r: F.when(r > 0, F.element_at(cutoffs, F.greatest(r, F.lit(1)).cast("int")))).alias(rule))
    return per.select("stratum", *out)


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows of features with `over`: the rules that reject each."""
    chosen = F.broadcast(cutoffs.select(F.col("stratum").alias("_s"), *(F.col(r).alias(f"_{r}") for r in RULES)))
    joined = rows.withColumn("stratum", stratum()).join(chosen, F.col("stratum") == F.col("_s"), "left")
    over = F.array_compact(F.array(*(F.when(F.expr(v) > F.col(f"_{r}"), F.lit(r)) for r, (v, _) in RULES.items())))
    return joined.withColumn("over", over).drop("_s", "stratum", *(f"_{r}" for r in RULES))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = staged(features(docs), "features")
    result = judged(rows, thresholds(trials(rows, labels)))
    return result.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size("over") == 0)).alias("kept"), F.array_join("over", ",").alias("rejected_by"),
    )


def oracle() -> str:
    """The same in DuckDB, with the binomial tail by logarithms of the gamma function."""
    ladders, chosen, over = [], [], []
    p, level = 0.02 / len(RULES), 0.05 / (len(RULES) * len(STRATA))
    strata = "CASE " + " ".join(f"WHEN n_words >= {least} THEN {k}" for k, least in reversed(list(enumerate(STRATA)))) + " END"
    tail = (
        f"CASE WHEN k >= n * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) "
        f"- lgamma(n - i + 1) + i * ln({p!r}::DOUBLE) + (n - i) * ln(1 - {p!r}::DOUBLE)))) END"
    )
    for rule, (value, ladder) in RULES.items():
        for step, c in enumerate(ladder):
            ladders.append(f"SELECT stratum, '{rule}' AS rule, {step} AS step, {c!r}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (({value}) > {c!r}::DOUBLE) AS k FROM good GROUP BY stratum")
        chosen.append(f"min(cutoff) FILTER (rule = '{rule}') AS c_{rule}")
        over.append(f"CASE WHEN ({value}) > c_{rule} THEN '{rule}' END")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM docs),
grams AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM listed)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT i + j) AS r FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
feats AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ln)::BIGINT AS n_lines,
  (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words FROM listed LEFT JOIN reps USING (rid)),
based AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {strata} AS stratum FROM feats),
fine AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
good AS (SELECT based.* FROM based JOIN fine ON based.doc_id = fine.doc_id WHERE NOT base_failed
  QUALIFY row_number() OVER (PARTITION BY based.doc_id ORDER BY n_words DESC, word_chars DESC, n_symbols DESC, n_lines DESC, n_dup_lines DESC, n_repeat_words DESC) = 1),
alone AS ({" UNION ALL ".join(ladders)}),
ladder AS (SELECT near.to AS stratum, rule, step, cutoff, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k
  FROM (SELECT a.to, r.radius FROM (SELECT unnest(range({len(STRATA)})) AS to) a, (SELECT unnest(range({len(STRATA)})) AS radius) r) near
  JOIN alone ON abs(near.to - alone.stratum) <= near.radius GROUP BY near.to, near.radius, rule, step, cutoff HAVING sum(n) >= {least_trials()}
  QUALIFY near.radius = min(near.radius) OVER (PARTITION BY near.to)),
tested AS (SELECT *, ({tail}) <= {level!r}::DOUBLE AS ok FROM ladder),
run AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS still FROM tested),
cutoffs AS (SELECT stratum AS cs, {", ".join(chosen)} FROM run WHERE still GROUP BY stratum),
final AS (SELECT based.*, list_filter([{", ".join(over)}], lambda x: x IS NOT NULL) AS over FROM based LEFT JOIN cutoffs ON stratum = cs)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND len(over) = 0) AS kept, array_to_string(over, ',') AS rejected_by FROM final"""
