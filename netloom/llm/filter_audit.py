"""Filter interaction audit: how five filters overlap, counted once for every order in which they could be applied.

1. Texts are merged by their digest, so that copies are counted once, and dealt out by it. Words are exploded and aggregated by
   (text, word), then by text, all in the stage that the texts were dealt to: no word is shuffled.
2. Other flags are aggregated by (document, text) and outer-joined: labels, the first document of a text, word totals. Copies of a
   text in one part with the same flags are one row with a count before they meet its totals.
3. A document's flags make a mask of five bits; a part is one row of 32 conditional counts (and as many of good and of toxic
   documents), from which every order and step follows by sums over masks.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from .quality_rules import SYMBOLS

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
#: Characters that a clean text doesn't hold.
MARKS = tuple(m for m in SYMBOLS if m not in "<>")
SPACES = "\t\n\x0b\f\r"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def word_totals(docs: DataFrame) -> DataFrame:
    """``digest, n_words, n_distinct`` of every different text; a text without words has 0 of both."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.groupBy(_digest(text).alias("digest")).agg(F.first(text).alias("text"))
    spaced = reduce(lambda x, m: F.replace(x, F.lit(m), F.lit(" ")), SPACES, F.col("text"))
    each = texts.select("digest", F.explode(F.split(spaced, " ")).alias("word")).groupBy("digest", "word").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("word") != ""
    return each.groupBy("digest").agg(F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_words"), F.count_if(real).alias("n_distinct"))


def document_flags(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, part, c, d, n``: documents that are equal in all of these are one row."""
    text = F.coalesce("text", F.lit(""))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text)
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in MARKS])
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest(text).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"), capitals.alias("c"), marked.alias("d"))
    return own.groupBy("doc_id", "digest", "part", "c", "d").agg(F.count(F.lit(1)).alias("n"))


def flag_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters that they fail (bit 0 for A to bit 4 for E) and their labels."""
    flags = materialize(document_flags(docs), "audit-flags")
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # the key of this join has the document in it: copies of one text are spread
    flags = flags.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    no = F.lit(False)
    merged = flags.groupBy("digest", "part", "c", "d", copy.alias("e"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))
    whole = merged.join(word_totals(docs), "digest", "outer")
    fails = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), F.col("c"), F.col("d"), F.col("e")]
    mask = reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])
    return whole.groupBy("part", mask.alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> Column:
    """All orders and their steps as one constant array of (filter_order, step, own bit, bits of earlier filters)."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        earlier = 0
        for step, k in enumerate(order, 1):
            rows.append({"filter_order": "".join(LETTERS[x] for x in order), "step": step, "bit": 1 << k, "earlier": earlier})
            earlier |= 1 << k
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, earlier: int>>")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the five filters and step: documents kept, removed, and what the filter's place makes of it.

    Parts are values of ``lang``, null and empty ones together. A null or empty text has no words and fails A alone, or E too. E compares ids:
    a row with a null id is neither a copy nor the first of its copies; rows that repeat id and text are judged alike. An id
    with several labels has each that any of its label rows gives it; without one it is neither good nor toxic. An empty table gives no
    row. Other columns aren't read."""
    masks = flag_masks(docs, labels)
    total = lambda which, m: F.coalesce(F.sum(F.when((F.col("mask") == m) & which, F.col("n"))), F.lit(0))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = masks.groupBy("part").agg(*[total(which, m).alias(f"{kind}_{m}") for kind, which in kinds.items() for m in range(MASKS)])
    arrays = [F.array(*[F.col(f"{kind}_{m}") for m in range(MASKS)]).alias(kind) for kind in kinds]
    s = counted.select("part", *arrays, F.explode(_steps()).alias("s")).select("part", *kinds, "s.*")

    def over(kind: str, condition) -> Column:
        """The sum over the masks that meet the condition."""
        return F.aggregate(F.zip_with(F.col(kind), F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda n, m: F.when(condition(m), n).otherwise(F.lit(0))), F.lit(0).cast("bigint"), lambda a, n: a + n)

    bit, earlier = F.col("bit"), F.col("earlier")
    holds = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: holds(m, bit) & ~holds(m, earlier)
    # a document that fails k filters is removed by each of them in 120 / k orders
    shares = F.aggregate(F.zip_with(F.col("all"), F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda n, m: F.when(holds(m, bit), n * F.lit(120) / F.bit_count(m)).otherwise(F.lit(0.0)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return s.select(
        "part",
        "filter_order",
        "step",
        over("all", lambda m: ~holds(m, bit.bitwiseOR(earlier))).alias("kept"),
        over("all", here).alias("removed"),
        over("all", lambda m: holds(m, bit) & holds(m, earlier)).alias("redundant"),
        over("all", lambda m: m == bit).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        shares.alias("shapley"),
    )
