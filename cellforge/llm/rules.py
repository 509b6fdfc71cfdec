"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document if its value exceeds a cutoff. For every stratum (language), rule and
cutoff of a fixed grid, the labelled holdout gives n clean documents of which k would be rejected.
A cutoff is certified if the exact binomial tail P(Bin(n, alpha) <= k) is at most delta over the
number of all tests (Bonferroni): with probability 1 - delta no certified cutoff rejects more than
alpha of a stratum's clean documents. Among the certified cutoffs of a rule the most useful is
taken: the one that rejects most labelled junk, where each clean document it rejects in the holdout
counts against CLEAN_COST of junk, and the highest of equals. A rule of which no certified cutoff is
of use abstains in that stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a stratum's clean documents that one rule may reject, and the chance that any bound fails.
ALPHA = 0.01
DELTA = 0.05
#: Documents of junk that a rule must reject for each clean one.
CLEAN_COST = 100
#: Value of a rule (an integer) and its grid of cutoffs.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols_permille": ("CASE WHEN word_chars > 0 THEN (1000 * n_symbols) div word_chars ELSE 0 END", (5, 10, 20, 35, 50, 80, 120, 200)),
    "bangs_permille": ("CASE WHEN word_chars > 0 THEN (1000 * n_bangs) div word_chars ELSE 0 END", (5, 10, 20, 35, 50, 80, 120, 200)),
    "repeat_percent": ("CASE WHEN n_words > 0 THEN (100 * n_repeat_words) div n_words ELSE 0 END", (5, 8, 11, 14, 17, 20, 25, 30)),
    "dup_lines_percent": ("CASE WHEN n_lines > 0 THEN (100 * n_dup_lines) div n_lines ELSE 0 END", (5, 10, 20, 30, 40, 50, 60, 75)),
    "word_length_tenths": ("CASE WHEN n_words > 0 THEN (10 * word_chars) div n_words ELSE 0 END", (60, 70, 80, 90, 100, 120, 150, 200)),
}


MADE = ["n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _repeat_words(h: Column, n: Column) -> Column:
    """Words in windows of 8 that occur twice or more, from the words' hashes. Linear but for one sort,
    which only texts with a repeated window pay for."""
    win = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + o) for o in range(WINDOW)]))
    return F.when(n >= WINDOW, win).otherwise(F.array().cast("array<bigint>"))


def _covered(win: Column) -> Column:
    s = F.sort_array(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(s: Column) -> Column:
        at = F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]))
        return F.sort_array(F.transform(at, lambda x: x["i"]))

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # transform over a one-element array binds a value that is used more than once
    one = F.transform(F.transform(F.array(s), places), cover)
    return F.get(one, F.lit(0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the rule inputs to the documents; a null text has none of anything.

    Everything is computed inside the row: no shuffle, whole texts, memory bounded by a text.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"_t": t, "_words": common.words(t), "_lines": F.filter(F.split(t, "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]"))})
    d = d.withColumns({"n_words": F.size("_words").cast("long"), "_h": F.transform("_words", lambda w: F.xxhash64(w))})
    d = d.withColumn("_win", _repeat_words(F.col("_h"), F.size("_words")))
    made = (
        {
            "n_words": F.col("n_words"),
            "word_chars": F.length(F.translate("_t", " \t\n\u000b\f\r", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
            "n_bangs": (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_win") > F.size(F.array_distinct("_win")), _covered(F.col("_win"))).otherwise(0).cast("long"),
        }
    )
    # An explode of one element: without it Catalyst copies these expressions into every later use and
    # filter, and planning takes minutes.
    d = d.select(*docs.columns, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made"))
    d = d.select(*docs.columns, "_made.*")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exact, in log space; 1 where k reaches the mean (no bound can hold there)."""
    step = lambda a, i: F.struct(
        (a["l"] + F.log((n - i + 1) / i) + F.log(F.lit(alpha / (1 - alpha)))).alias("l"),
        (a["s"] + F.exp(a["l"] + F.log((n - i + 1) / i) + F.log(F.lit(alpha / (1 - alpha))))).alias("s"),
    )
    l0 = n * F.log(F.lit(1 - alpha))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, F.struct(l0.alias("l"), F.exp(l0).alias("s")), step, lambda a: a["s"])
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(tail)


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, junk, p): the certified cutoff of every stratum and rule that has one.

    One aggregation over the labelled documents; what follows has strata x rules x cutoffs rows.
    """
    lab = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"))
    base = measured.where(~F.col("base_failed")).join(lab, "doc_id").where(F.col("_q").isNotNull())
    aggs, cells = [], []
    for r, (value, grid) in RULES.items():
        for c in grid:
            over = F.expr(f"({value}) > {c}")
            aggs += [F.count(F.when(over & (F.col("_q") == 1), 1)).alias(f"k_{r}_{c}"), F.count(F.when(over & (F.col("_q") == 0), 1)).alias(f"j_{r}_{c}")]
            cells.append(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{c}").alias("k"), F.col(f"j_{r}_{c}").alias("junk")))
    counts = base.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.when(F.col("_q") == 1, 1)).alias("n"), *aggs)
    tests = counts.withColumn("_m", F.count("*").over(Window.partitionBy())).select("stratum", "n", "_m", F.explode(F.array(*cells)).alias("c")).select("stratum", "n", "_m", "c.*")
    tests = tests.withColumn("p", binomial_tail(F.col("n"), F.col("k"), alpha))
    tests = tests.withColumn("use", F.col("junk") - CLEAN_COST * F.col("k"))
    good = tests.where((F.col("p") <= F.lit(delta) / (F.col("_m") * len(cells))) & (F.col("use") > 0))
    best = good.groupBy("stratum", "rule").agg(F.max(F.struct("use", "cutoff", "n", "k", "junk", "p")).alias("b"))
    return best.select("stratum", "rule", "b.cutoff", "b.n", "b.k", "b.junk", "b.p")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept``: false if the base test failed or a rule exceeds its stratum's certified cutoff."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in RULES])
    wide = wide.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("stratum").cast("string")), F.lit("n"))).drop("stratum")
    d = measured.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n")))
    d = common.small_join(d, wide, "_s")
    over = reduce(lambda a, b: a | b, [F.coalesce(F.expr(f"({value})") > F.col(f"_c_{r}"), F.lit(False)) for r, (value, _) in RULES.items()])
    return d.withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", *[f"_c_{r}" for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their measures, ``base_failed`` and ``kept``, all their columns included.

    The labelled documents are measured for the calibration, then all documents for the verdict, in
    one pass without a shuffle. Ids in ``labels`` may repeat (the best label counts) or be null
    (ignored). An empty label table certifies nothing: only the base test rejects. A null language is
    a stratum of its own. Extra columns pass through, unless the operator makes one of that name.
    """
    named = ("doc_id", "text", "lang")
    plain, _ = common.stash(docs, named)
    have = labels.select("doc_id").where("doc_id is not null").distinct()
    labelled = common.keep(measure(plain.select(*named).join(have, "doc_id", "left_semi")).drop("text"), "measured")
    out = judge(measure(plain), common.keep(calibrate(labelled, labels).coalesce(1), "cutoffs"))
    return out.select(*common.unstash(docs, MADE, named), *MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = common.keep(measure(docs).drop("text"), "measured")  # narrow: no text
    out = judge(measured, common.keep(calibrate(measured, common.table(spark, sf_dir, "labels")).coalesce(1), "cutoffs"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_cte() -> str:
    grid = ", ".join(f"('{r}', {c})" for r, (_, g) in RULES.items() for c in g)
    vals = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{r}' AS rule, ({v.replace(' div ', ' // ')})::BIGINT AS value FROM m" for r, (v, _) in RULES.items())
    cells = sum(len(g) for _, g in RULES.values())
    return rf"""
w AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
xd AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c >= 2),
xc AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM xd) GROUP BY doc_id),
m0 AS (SELECT w.* EXCLUDE (ws, ls), len(ws)::BIGINT AS n_words, length(translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::BIGINT AS word_chars,
        (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')))::BIGINT AS n_bangs,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(xc.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN xc USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m0),
v AS ({vals}),
lab AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cal AS (SELECT lang, v.rule, g.cutoff, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND value > g.cutoff) AS k, count(*) FILTER (q = 0 AND value > g.cutoff) AS junk
        FROM v JOIN lab USING (doc_id) JOIN (VALUES {grid}) g(rule, cutoff) ON g.rule = v.rule WHERE NOT base_failed AND q IS NOT NULL GROUP BY ALL),
pv AS (SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln({1 - ALPHA})))) END AS p,
        (SELECT count(*) FROM (SELECT DISTINCT lang FROM cal)) AS strata FROM cal),
best AS (SELECT lang, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY junk - {CLEAN_COST} * k DESC, cutoff DESC) AS r FROM pv WHERE p <= {DELTA} / (strata * {cells}) AND junk > {CLEAN_COST} * k) WHERE r = 1),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN best ON v.rule = best.rule AND v.lang IS NOT DISTINCT FROM best.lang WHERE v.value > best.cutoff)"""


def oracle_sql() -> str:
    return f"WITH {oracle_cte()} SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND m.doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"
