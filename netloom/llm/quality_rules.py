"""Quality rules: one table of thresholds, compiled into one Spark projection without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, German, French and Spanish that running text can't do without.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au aux ce dans de du en est et il la le les ne pas pour que qui sur un une "
    "al con del el ella es los las no para por se su sus y"
).split()

#: As they stand in running text, at the start of a sentence, and in headings.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w[:1].upper() + w[1:], w.upper())})

#: Metric, comparison that a kept text fulfils, threshold. A ratio of a text without words is 0.
THRESHOLDS = [
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 40.0),
    ("symbol_ratio", "<=", 0.1),
    ("exclamation_ratio", "<=", 0.2),
    ("dup_line_ratio", "<=", 0.3),
    ("bullet_line_ratio", "<=", 0.9),
    ("one_word_line_ratio", "<=", 0.8),
    ("stop_word_ratio", ">=", 0.02),
]
#: Ratios of lines are taken of this many lines at least, so that a short text's one repeated or bulleted line isn't a third of it.
LEAST_LINES = 10
#: Words from which a text must have stop words; a shorter one's ratio counts as 1.
LEAST_WORDS = 40

WHITE = "[ \t-\r]"
WINDOW = 5


WHITE_MARKS = (" ", "\t", "\n", "\x0b", "\f", "\r")
BULLETS = ("-", "*", "\u2022")
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")


def count_of(text: Column, marks: tuple[str, ...]) -> Column:
    """How often the ASCII marks stand in the text: bytes that go when they are taken out."""
    rest = reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), marks, text)
    return (F.octet_length(text) - F.octet_length(rest)).cast("bigint")


def beside(array: Column, by: int, other: Column) -> tuple[Column, Column]:
    """``array`` and ``other`` from its ``by``-th element on, cut to the same length."""
    n = F.greatest(F.least(F.size(array), F.size(other) - by), F.lit(0))
    return F.slice(array, F.lit(1), n), F.slice(other, F.lit(by + 1), n)


def with_windows(docs: DataFrame) -> DataFrame:
    """Add ``q_windows``, hashes of all five-word windows of ``q_list``; shorter texts have none.

    Every step is a column of its own: an expression that stands twice in another would be evaluated twice."""
    out = docs.withColumn("q_hashes", F.transform("q_list", lambda w: F.xxhash64(w)))
    for name, a, by, b in (("q_pairs", "q_hashes", 1, "q_hashes"), ("q_fours", "q_pairs", 2, "q_pairs"), ("q_windows", "q_fours", 4, "q_hashes")):
        out = out.withColumn(name, F.zip_with(*beside(F.col(a), by, F.col(b)), lambda x, y: F.xxhash64(x, y)))
    return out.drop("q_hashes", "q_pairs", "q_fours")


def with_repeat_words(docs: DataFrame) -> DataFrame:
    """Add ``q_n_repeat_words``: how many words stand in a window that the text has twice or more.

    Windows are sorted by (hash, place); neighbours with equal hashes give the places of repeated
    windows. Sorted places then cover 5 words each, or as many as lie before the next place.
    """
    repeats = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    out = docs.withColumn("q_placed", F.when(repeats, F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.zip_with(*beside(F.col("q_placed"), 1, F.col("q_placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("q_places", F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    steps = F.zip_with(*beside(F.col("q_places"), 1, F.col("q_places")), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    # the last place has no next one and covers a whole window
    covered = F.aggregate(steps, F.lit(WINDOW).cast("bigint"), lambda total, x: total + x)
    return out.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("q_placed", "q_places")


def quality_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's row as one column ``q_row``, so that no name in it can clash, and the metrics of ``THRESHOLDS`` and of the
    contract as columns prefixed ``q_``.

    A null or empty text has no words, and all counts are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.struct("*").alias("q_row"), text.alias("q_text"))
    trimmed = F.btrim(F.col("q_text"), F.lit("".join(WHITE_MARKS)))
    out = out.withColumn("q_list", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE + "+")))
    out = with_repeat_words(with_windows(out))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    n = F.size("q_list").cast("bigint")
    out = out.withColumns(
        {
            "q_n_words": n,
            "q_word_chars": F.length("q_text").cast("bigint") - count_of(F.col("q_text"), WHITE_MARKS),
            "q_n_symbols": count_of(F.col("q_text"), SYMBOLS),
            "q_n_marks": count_of(F.col("q_text"), ("!",)),
            "q_lines": lines,
            "q_n_stop": F.size(F.filter("q_list", lambda w: w.isin(*STOP_FORMS))).cast("bigint"),
        }
    )
    one_word = lambda x: ~F.contains(F.btrim(x, F.lit("".join(WHITE_MARKS))), F.lit(" "))
    out = out.withColumns(
        {
            "q_n_lines": F.size("q_lines").cast("bigint"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
            "q_n_bullets": F.size(F.filter("q_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS))).cast("bigint"),
            "q_n_one_word": F.size(F.filter("q_lines", one_word)).cast("bigint"),
        }
    )
    return out.drop("q_text", "q_list", "q_windows", "q_lines")


def metric_columns() -> dict[str, Column]:
    words = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("q_n_lines"), F.lit(LEAST_LINES)).cast("double")
    return {
        "mean_word_chars": F.col("q_word_chars") / words,
        "symbol_ratio": F.col("q_n_symbols") / words,
        "exclamation_ratio": F.col("q_n_marks") / words,
        "dup_line_ratio": F.col("q_n_dup_lines") / lines,
        "bullet_line_ratio": F.col("q_n_bullets") / lines,
        "one_word_line_ratio": F.col("q_n_one_word") / lines,
        "stop_word_ratio": F.when(F.col("q_n_words") < LEAST_WORDS, 1.0).otherwise(F.col("q_n_stop") / words),
    }


def verdict(thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> Column:
    """All rules of the table as one boolean column over ``quality_metrics``."""
    metrics = metric_columns()
    rules = [metrics[name] >= F.lit(limit) if sign == ">=" else metrics[name] <= F.lit(limit) for name, sign, limit in thresholds]
    return reduce(lambda a, b: a & b, rules)


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """The input with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` and ``kept``.

    Null and empty texts have 0 words, so they fail. Repeated rows are judged alike, each on its own.
    Input columns with these names are replaced; other columns pass through. No shuffle.
    """
    out = quality_metrics(docs, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    result = {x: F.col("q_" + x) for x in names} | {"base_failed": failed, "kept": ~failed & verdict(thresholds)}
    keep = [F.col("q_row").getField(c).alias(c) for c in docs.columns if c not in result]
    return out.select(*keep, *[v.alias(k) for k, v in result.items()])


def kept_rows(docs: DataFrame, text_col: str = "text", thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """The input's rows that ``quality_rules`` keeps, with the input's columns.

    The verdict goes through a generator: a plain filter on it would be pushed down through all steps, and
    each step's expression copied into the next one's as often as it stands there."""
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    judged = quality_rules(whole, "text", thresholds)
    passed = judged.select("row", F.explode_outer(F.array("kept")).alias("passed"))
    return passed.filter("passed").select("row.*")
