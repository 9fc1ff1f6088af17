"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, words

WINDOW = 8

#: Frequent function words (fixed values).
STOP_WORDS = (
    "the of and to in is that for it as with be by this are was at from or an on not have you "
    "de la que el en los se del las por con para una su al lo un es "
    "le et les des du une est pour qui dans au sur par ne pas "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; None leaves a side open. A null measure fails."""

    measure: str
    low: float | None = None
    high: float | None = None


#: measure, least, most.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("marks_per_word", None, 0.5),
    Rule("stop_words_per_word", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.3),
)


def repeat_words(ws: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of `width` words found twice or more in the text (64-bit window keys)."""
    keys = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))),
    )

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: ((j > 0) & (F.get(s, j - 1)["k"] == F.get(s, j)["k"])) | ((j < last) & (F.get(s, j + 1)["k"] == F.get(s, j)["k"])),
        )
        at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + width).alias("end"), (a["n"] + width - F.greatest(a["end"] - p, F.lit(0))).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    def count(k: Column) -> Column:
        return F.when(F.size(k) == F.size(F.array_distinct(k)), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), covered)
        )

    return F.when(F.size(ws) < width, F.lit(0)).otherwise(let(keys, count)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures beside: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios.

    A null or empty text has no words: counts 0, ratios over words null, ratios over lines 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    plain = lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeats"), F.size(F.filter(w, lambda x: plain(x).isin(STOP_WORDS))).alias("stops")
        ),
    )
    of_lines = let(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dups")),
    )
    # a generator keeps the optimizer from copying these expressions to each place that uses a measure
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "marks_per_word", "stop_words_per_word", "repeat_word_ratio", "dup_line_ratio"]
    once = F.struct(of_words.alias("w"), of_lines.alias("l"), gone(r"[#*$%&|<>]").alias("symbols"), gone(r"[!?]").alias("marks"))
    out = docs.drop(*names).select("*", F.explode(F.array(once)).alias("__m"))
    m = F.col("__m")
    per_word = lambda c: F.when(m["w"]["n"] > 0, c / m["w"]["n"])
    values = [
        m["w"]["n"].cast("long"), m["w"]["chars"].cast("long"), m["symbols"].cast("long"), m["l"]["dups"].cast("long"), m["w"]["repeats"].cast("long"),
        per_word(m["w"]["chars"]), per_word(m["symbols"]), per_word(m["marks"]), per_word(m["w"]["stops"]), per_word(m["w"]["repeats"]),
        F.when(m["l"]["n"] > 0, m["l"]["dups"] / m["l"]["n"]).otherwise(0.0),
    ]
    return out.withColumns(dict(zip(names, values, strict=True))).drop("__m")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures() fails, in the table's order."""
    fails = []
    for r in rules:
        c, ok = F.col(r.measure), F.col(r.measure).isNotNull()
        ok = ok if r.low is None else ok & (c >= F.lit(r.low))
        ok = ok if r.high is None else ok & (c <= F.lit(r.high))
        fails.append(F.when(~ok, F.lit(r.measure)))
    return F.array_compact(F.array(*fails))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with measures, base_failed, failed_rules and kept. Columns of docs keep their place; result names replace equal ones."""
    out = measures(docs, text).withColumns(
        {"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")), "failed_rules": compile_rules(rules)}
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents: a row each, repeats included; null and empty texts have no words and fail. Other columns are not read."""
    out = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), range({WINDOW}) r(j)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP_SQL}))) AS stops
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       coalesce(n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
         AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3 AND marks / n_words <= 0.5
         AND stops / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / n_words <= 0.3, FALSE) AS kept
FROM m
"""
