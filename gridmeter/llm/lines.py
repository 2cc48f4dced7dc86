"""Quality rules: counts within each text, and removal of lines that many documents of a host share. Built-in functions only.

Words are runs of other characters than SPACE; a null text has none. Base rules fail texts of under 20 words and texts of
which over 30 % of the words lie in repeated 8-word windows. The method then takes every line that has a word, in lower
case with single blanks, counts the distinct documents of each host that hold it, removes lines above the limit, and
rejects a document of which too little is left.

Documents are told apart by (doc_id, hash of the text); a null id is an id of its own, a null host a host of its own.
Rows that repeat an id and text are judged alike and count once. Ties cannot arise: limits are strict comparisons of counts.
Extra columns are left out. Very long texts stay in one row: lines are hashed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.llm.common import SPACE, settle, words_of

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A line goes if more than `documents` and more than `share` of its host's documents hold it; a document is depleted
    if under `left_words` words, or under `left_share` of its words, are left."""

    documents: int = 50
    share: float = 0.005
    left_words: int = 20
    left_share: float = 0.3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: an expression inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Only texts with a repeated window are sorted: positions of equal window hashes are neighbours then, and a position
    covers the words up to the next one, `window` at most.
    """
    none = F.lit(0).cast("long")

    def repeated(o: Column) -> Column:
        twice = F.transform(o, lambda x, k: F.when((F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]), x["i"]))
        return _cover(F.array_sort(F.filter(twice, lambda i: i.isNotNull())), window)

    def sort_if_needed(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(spans)) == F.size(spans), none).otherwise(bind(ordered, repeated))

    def doubled(a: Column, step: int) -> Column:
        """Hashes of runs twice as long; what is left at the end is cut off."""
        return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))

    def windows(hashed: Column) -> Column:
        if window != 8:
            raise ValueError("windows are hashed by doubling three times")
        spans = bind(doubled(hashed, 1), lambda two: bind(doubled(two, 2), lambda four: bind(doubled(four, 4), sort_if_needed)))
        return F.when(F.size(hashed) > window, spans).otherwise(none)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _cover(positions: Column, window: int) -> Column:
    """Length of the union of windows at ascending positions."""
    return F.aggregate(
        positions, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).cast("int").alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"), p.alias("last")),
        lambda acc: acc["sum"],
    )


def base_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by_words = bind(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("twice"),
    ))
    by_lines = bind(lines_of(F.col("text")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), by_words.alias("by_words"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        by_lines.alias("n_dup_lines"),
    )
    rows = rows.select(
        "doc_id", "text_hash", F.col("by_words.n").alias("n_words"), F.col("by_words.chars").alias("word_chars"), "n_symbols",
        "n_dup_lines", F.col("by_words.twice").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """Lower case, single blanks, none at the ends. Most lines have single blanks already, which is cheap to see."""
    odd = F.contains(line, F.lit("  "))
    for c in SPACE[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def host_lines(docs: DataFrame, host: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, host, text_hash, at, line, words): every line of each document, its text as a hash, and its number of words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    line = F.transform(lines_of(F.col("text")), lambda x: normalised(x))
    # Two steps, so that the text itself is not carried along with each of its lines.
    rows = rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), line.alias("lines"))
    rows = rows.select("doc_id", "host", "text_hash", F.posexplode("lines").alias("at", "line"))
    rows = rows.withColumn("words", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).withColumn("line", F.xxhash64("line"))
    return rows


def frequent_lines(lines: DataFrame, docs: DataFrame, host: str, limits: Limits) -> DataFrame:
    """(host, line) of the lines above the limits. Documents of a line are made distinct first, spread by document."""
    per_host = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("in_host"))
    found = lines.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    found = found.filter(F.col("n") > limits.documents)
    return found.join(per_host, found["host"].eqNullSafe(per_host["host"])).filter(F.col("n") > limits.share * F.col("in_host")).select(found["host"], "line")


def line_quality(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """Base counts of every row, with the words left after frequent lines went, and the verdict `kept`."""
    lines = settle(host_lines(docs, host, text, doc_id), "host-lines")
    often = frequent_lines(lines, docs, host, limits).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    hit = lines.join(often, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    # By place first, so that a row given twice does not lose its words twice.
    gone = hit.groupBy("doc_id", "text_hash", "at").agg(F.max("words").alias("words"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.sum("words").cast("long").alias("gone"))
    base = base_rules(docs, text, doc_id)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    out = base.join(gone, base["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0).cast("long"))
    depleted = (left < limits.left_words) | (left < limits.left_share * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), left.alias("n_words_left"),
    )
