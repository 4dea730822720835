"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Results for odd rows: a null text counts as one without words; such rows, and any with under 50
words, have base_failed true and kept false. Repeated rows are judged row by row. Columns other
than those named in the result pass through untouched only where `measure` is called on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for on as was are by this from at or an".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus ne se".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}

#: (rule, ratio, lowest, highest): a text is kept if each ratio is inside its bounds.
THRESHOLDS = (
    ("length", "n_words", 50, None),
    ("word_length", "word_chars / n_words", 1.5, 14.0),
    ("symbols", "n_symbols / n_words", None, 0.25),
    ("shouting", "n_shouts / n_words", None, 0.3),
    ("dup_lines", "n_dup_lines / n_lines", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
)


def repeated_words(w: Column) -> Column:
    """Words in the 3-word windows of w that occur twice or more. Windows are sorted by hash, so
    the cost is n log n in a text's words however often one of them repeats."""
    def twins(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda j: s[j]["i"]))

    def covered(starts: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, none, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")))["n"]

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(let(pairs, twins))).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) >= 3, let(hashes, of_hashes)).otherwise(0).cast("long")


def measure(text: Column) -> dict[str, Column]:
    """Counts of a text, each a built-in expression; named as in THRESHOLDS."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({x for v in STOP_WORDS.values() for x in v})
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(stop))).cast("long").alias("n_stop_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shouts"),
    )
    return {
        "of_words": let(words(text), of_words),
        "of_lines": let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    }


def verdict(rules=THRESHOLDS) -> Column:
    """The table as one predicate; a ratio over zero fails."""
    ok = F.lit(True)
    for _, ratio, low, high in rules:
        top, _, under = ratio.partition(" / ")
        value = F.expr(f"cast({top} as double) / nullif({under}, 0)" if under else f"cast({top} as double)")
        ok &= F.coalesce((F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high), F.lit(False))
    return ok


def quality_rules(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", *[c.alias(n) for n, c in measure(F.col("text")).items()])
    flat = rows.select("doc_id", "of_words.*", "of_lines.*", "n_symbols")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + d) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w.w, lambda x: list_contains([{stop}], lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words,
        len(list_filter(w.w, lambda x: suffix(x, '!!')))::BIGINT AS n_shouts FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM f
"""


def oracle() -> str:
    stop = ", ".join(f"'{x}'" for x in sorted({x for v in STOP_WORDS.values() for x in v}))
    tests = []
    for _, ratio, low, high in THRESHOLDS:
        top, _, under = ratio.partition(" / ")
        value = f"({top}::DOUBLE / nullif({under}, 0))" if under else f"{top}::DOUBLE"
        tests += [f"coalesce({value} {op} {bound}, false)" for op, bound in ((">=", low), ("<=", high)) if bound is not None]
    return ORACLE_SQL.replace("{stop}", stop).replace("{rules}", " AND ".join(tests))
