"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a column expression over the words and lines of the text, every rule a row of ``RULES``; the verdict is
one AND over all rows. Nothing is shuffled and no Python runs on the executors.

Null and empty text: no words, all measures 0, ``base_failed`` true and ``kept`` false. Repeated rows are measured each
on their own, an empty table gives an empty result, and extra columns of the input stay as they are (a column of the
input with the name of a measure is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Function words of the four languages.
STOP_WORDS = (
    "the of and to a in is that for it as was with on by an be this are or at from not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "de la que el en y los se del las un por con una su para al lo como más o "
    "le et les des est dans du qui ne sur pas au par plus une ce il sont avec"
).split()
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})

#: (measure, least, most): a document is kept if every measure lies within its row; None is no limit.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 20, None),
    ("mean_word_length", 1.5, 20),
    ("symbol_ratio", None, 0.25),
    ("pipe_ratio", None, 0.10),
    ("stop_word_ratio", 0.01, None),
    ("upper_ratio", None, 0.50),
    ("dup_line_ratio", None, 0.50),
    ("repeat_ratio", None, 0.30),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
    ("same_word_ratio", None, 0.30),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with one column for each measure. Steps are separate projections, so the words are split once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        "_words": F.filter(F.split(t, "[ \\x09-\\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, "[ \\x09-\\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "_n_pipes": F.regexp_count(t, F.lit("[|]")).cast("long"),
        "_n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_stop": F.size(F.filter("_words", lambda w: w.isin(STOP_FORMS))).cast("long"),
        "_n_same": F.size(F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1)))).cast("long"),
        "_n_bullets": F.size(F.filter("_lines", lambda s: s.rlike("^\\s*[-*•]"))).cast("long"),
        "_n_dots": F.size(F.filter("_lines", lambda s: s.rlike("([.]{3}|…)\\s*$"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    following = ", ".join(f"_hashes[i + {k}]" for k in range(1, REPEAT_WIDTH))
    df = df.withColumn("_windows", F.expr(
        f"transform(slice(_hashes, 1, greatest(size(_hashes) - {REPEAT_WIDTH - 1}, 0)), (h, i) -> xxhash64(h, {following}))"))
    # Most texts repeat no window. In the others the windows are sorted with their places: one found twice or more has an
    # equal neighbour then, and the words that any such window covers count once.
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    df = df.withColumn("_sorted", F.expr(
        "if(_repeats, array_sort(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))), array())"))
    df = df.withColumn("_at", F.expr("""if(_repeats, array_sort(transform(filter(_sorted, (x, k) ->
        (k > 0 and x.h = _sorted[k - 1].h) or (k < size(_sorted) - 1 and x.h = _sorted[k + 1].h)), x -> x.i)), array())"""))
    df = df.withColumn("n_repeat_words", F.expr(f"""aggregate(_at, named_struct('n', 0L, 'stop', 0),
        (s, i) -> named_struct('n', s.n + {REPEAT_WIDTH} - greatest(s.stop - i, 0), 'stop', i + {REPEAT_WIDTH}),
        s -> s.n)"""))
    df = df.withColumns({
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "pipe_ratio": _ratio(F.col("_n_pipes"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("_n_stop"), F.col("n_words")),
        "upper_ratio": _ratio(F.col("_n_upper"), F.col("word_chars")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
        "repeat_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "bullet_line_ratio": _ratio(F.col("_n_bullets"), F.col("_n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("_n_dots"), F.col("_n_lines")),
        "same_word_ratio": _ratio(F.col("_n_same"), F.col("n_words")),
    })
    return df.drop("_words", "_lines", "_hashes", "_windows", "_repeats", "_sorted", "_at", "_n_lines", "_n_pipes",
                   "_n_upper", "_n_stop", "_n_same", "_n_bullets", "_n_dots")


def verdict(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    passed = F.lit(True)
    for measure, least, most in rules:
        if least is not None:
            passed = passed & (F.col(measure) >= least)
        if most is not None:
            passed = passed & (F.col(measure) <= most)
    return passed


def quality(docs: DataFrame, text: str = "text", rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """All measures, ``base_failed`` and ``kept`` beside the input's columns."""
    # A column that is not deterministic keeps the optimizer from pulling a condition on the results, with every measure
    # written out in it many times over, below the projections that compute the measures once.
    measured = measures(docs, text).withColumn("_once", F.monotonically_increasing_id())
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measured.withColumn("base_failed", base_failed & (F.col("_once") >= 0))
    return judged.withColumn("kept", ~base_failed & verdict(rules) & (F.col("_once") >= 0)).drop("_once")


def passing(docs: DataFrame, text: str = "text", rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """The rows that are kept, with the input's columns whatever their names are."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("text"))
    return quality(held, "text", rules).filter("kept").select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql(rules: list[tuple[str, float | None, float | None]]) -> str:
    tests = [f"{m} >= {least}" for m, least, _ in rules if least is not None]
    return " AND ".join(tests + [f"{m} <= {most}" for m, _, most in rules if most is not None])


def check_sql(table: str = "documents", columns: str = "doc_id", rules=RULES) -> str:
    """DuckDB query with ``columns``, the measures, ``base_failed`` and ``kept`` (``doc_id`` has to be unique)."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT *, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '[^{space}]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^{space}]')) AS ls FROM d),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT_WIDTH - 2})) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {REPEAT_WIDTH - 1}], ' ') AS k FROM places),
twice AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (SELECT doc_id, unnest(range(i, i + {REPEAT_WIDTH})) AS p FROM windows JOIN twice USING (doc_id, k)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM covered GROUP BY doc_id),
m AS (SELECT w.*, len(ws) AS n_words, length(regexp_replace(t, '[{space}]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(ls) AS n_lines, length(t) - length(replace(t, '|', '')) AS n_pipes,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop,
             len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS n_same,
             len(list_filter(ls, lambda s: regexp_matches(s, '^\s*[-*•]'))) AS n_bullets,
             len(list_filter(ls, lambda s: regexp_matches(s, '([.]{{3}}|…)\s*$'))) AS n_dots
      FROM w LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(n_pipes / nullif(n_words, 0), 0) AS pipe_ratio,
             coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
             coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
             coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio,
             coalesce(n_dots / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
             coalesce(n_same / nullif(n_words, 0), 0) AS same_word_ratio,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT {columns}, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql(rules)} AS kept
FROM r"""
