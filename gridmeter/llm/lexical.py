"""Ranked lexical search by a scan: one automaton of all item terms counts them in the texts, without an index of documents.

Terms stand between blanks: texts are spelled with every separator as a blank, and the automaton holds each term with a blank
on both sides, so that a term is never found inside a longer one. A first scan counts how many documents hold each item term,
the number of documents and of all their terms; a second one scores. Outputs of the automaton are numbers of terms, which
lead to the items that hold them and how often. Every task keeps the best documents of each item and nothing else.

The automaton is broadcast, so its size is checked: items are dealt into passes of at most about `PAIRS` pairs of item and
term, each with its own two scans. A task then holds an automaton, and a score for each item and text of a small batch.

Null texts and texts without a term count for nothing and are never found; an item without a term, or null, has no rows, nor
has any item if no document has a term. Very long texts are scanned whole. Equal scores go by ascending id, null ids last.
Rows of documents that repeat are found each on their own. Rows of items that repeat id and text are one item; an id with
several texts is ranked for each of them. Extra columns are left out. Document ids are integers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.llm.common import settle

TOP = 10
#: Pairs of item and term of one pass: some 200 MB in a task.
PAIRS = 1_000_000
#: Scores (items times texts) that are held at once.
CELLS = 4_000_000
#: What terms are made of: ASCII letters and digits, and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by bytes of UTF-8: all bytes from 128 on belong to terms.
_SPELLED = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_BUILT: dict[str, object] = {}


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def spelled(text: str) -> str:
    """The text's terms between blanks, one character for each byte of UTF-8."""
    return f" {text.encode('utf-8', 'surrogatepass').translate(_SPELLED).decode('latin-1')} "


def automaton(key: str, terms: list[str]):
    """Automaton of the terms with their guards; one for each Python worker."""
    if key not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            built.add_word(spelled(term), number)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)


def counts(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each of `terms`."""
    shared, key = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, number = automaton(key, shared.value), len(shared.value)
        df, documents, size = np.zeros(number, dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                line = spelled(text.as_py())
                n = len(line.split())
                documents, size = documents + (n > 0), size + n
                df[list({v for _, v in built.iter(line)})] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [documents, size])))], ["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a term of this pass
    shared.unpersist()
    told = {r["term"]: r["n"] for r in found}
    return told.get(-1, 0), told.get(-2, 0), np.array([told.get(i, 0) for i in range(len(terms))], dtype=np.int64)


class Best:
    """The best documents of every item so far, by score and then id."""

    def __init__(self, items: int, top: int):
        self.items, self.top, self.least = items, top, np.ones(items, dtype=np.int64)
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.null = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item):]]))
        doc, null = np.concatenate((self.doc, doc[row])), np.concatenate((self.null, null[row]))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.top], item[rank < self.top]
        self.item, self.score, self.doc, self.null = item, score[order], doc[order], null[order]
        full = np.bincount(item, minlength=self.items) >= self.top
        last = np.searchsorted(item, np.arange(self.items), side="right") - 1
        self.least[full] = self.score[last[full]]


def scores(term: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int, postings: tuple[np.ndarray, ...], items: int) -> np.ndarray:
    """(rows, items) sums of the values of terms, as often as an item holds them; exact 64-bit integers."""
    begin, size, item, times = postings
    n = size[term]
    at = np.repeat(begin[term], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cell, worth = np.repeat(row, n) * items + item[at], np.repeat(value, n) * times[at]
    # Sums of doubles are exact for halves of this size.
    high = np.bincount(cell, weights=worth >> 24, minlength=rows * items).astype(np.int64)
    low = np.bincount(cell, weights=worth & 0xFFFFFF, minlength=rows * items).astype(np.int64)
    return ((high << 24) + low).reshape(rows, items)


def rank_pass(docs: DataFrame, held: DataFrame, top: int) -> DataFrame | None:
    """(item_id, mark, doc_id, score): of each task the best documents of the items in `held` (item_id, mark, term, times)."""
    spark = docs.sparkSession
    pairs = held.collect()  # at most about PAIRS rows
    if not pairs:
        return None
    terms = sorted({r["term"] for r in pairs})
    number = {t: i for i, t in enumerate(terms)}
    items = list(dict.fromkeys((r["item_id"], r["mark"]) for r in pairs))
    place = {x: i for i, x in enumerate(items)}
    documents, size, df = counts(docs.select("text"), terms)
    if not documents:
        return None
    term = np.array([number[r["term"]] for r in pairs])
    order = np.argsort(term, kind="stable")
    per = np.bincount(term, minlength=len(terms))
    postings = (
        np.cumsum(per) - per, per, np.array([place[r["item_id"], r["mark"]] for r in pairs])[order],
        np.array([r["times"] for r in pairs], dtype=np.int64)[order],
    )
    shared, key = spark.sparkContext.broadcast((terms, weights(documents, df), postings)), uuid.uuid4().hex
    names, marks = [x[0] for x in items], np.array([x[1] for x in items], dtype=np.int64)
    # What item ids look like in Arrow; they pass through as they are.
    kind = held.schema["item_id"].dataType
    schema = held.select("item_id", "mark").schema.add("doc_id", docs.schema["doc_id"].dataType).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        terms, weight, postings = shared.value
        built, best = automaton(key, terms), Best(len(names), top)
        step, id_type = max(1, CELLS // len(names)), None
        for batch in batches:
            id_type = batch.column(0).type
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                term, value, row = [], [], []
                for i, text in enumerate(part.column(1)):
                    line = spelled(text.as_py())
                    hit, tf = np.unique(np.fromiter((v for _, v in built.iter(line)), dtype=np.int64), return_counts=True)
                    if len(hit):
                        m = 100 - 75 + 75 * len(line.split()) * documents // size
                        term.append(hit)
                        value.append(weight[hit] * (1_000_000_000 * tf // (1000 * tf + 8 * m)))
                        row.append(np.full(len(hit), i))
                if term:
                    found = scores(np.concatenate(term), np.concatenate(value), np.concatenate(row), part.num_rows, postings, len(names))
                    ids = part.column(0)
                    best.add(found, ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False))
        if len(best.item):
            yield pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in best.item], to_arrow_type(kind)), pa.array(marks[best.item]),
                pa.array(best.doc, mask=best.null).cast(id_type), pa.array(best.score),
            ], ["item_id", "mark", "doc_id", "score"])

    return settle(docs.select("doc_id", "text").mapInArrow(run, schema), "lexical-best")


def rank(
    docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of every item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    held = items.select(F.col(item_id).alias("item_id"), F.xxhash64(item_text).alias("mark"), F.col(item_text).alias("text")).dropDuplicates()
    held = held.select("item_id", "mark", F.explode(terms_of(F.col("text"))).alias("term"))
    held = settle(held.groupBy("item_id", "mark", "term").agg(F.count("*").alias("times")), "lexical-items")
    passes = max(1, -(-held.count() // pairs))
    best = [rank_pass(rows, held.filter(F.pmod(F.xxhash64("item_id", "mark"), F.lit(passes)) == i), top) for i in range(passes)]
    best = [x for x in best if x is not None]
    if not best:
        schema = held.select("item_id").schema.add("rank", "integer").add("doc_id", rows.schema["doc_id"].dataType).add("score", "long")
        return spark.createDataFrame([], schema)
    every = best[0]
    for more in best[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
