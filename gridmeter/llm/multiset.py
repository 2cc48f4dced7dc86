"""Document fingerprints: a homomorphic multiset hash over the pieces of paragraphs. Built-in functions only.

A paragraph is a line with text, cut after sentence ends. Each piece is hashed to a wide vector of 128 bits (two 64-bit
hashes with different salts); a fingerprint is the number of pieces and the sum of their vectors, each lane modulo 2**16.
So the order of pieces does not matter, and a piece is inserted or deleted by adding or subtracting its vector
(`combine`, `without`). Lanes of bits also measure: the squared distance of two fingerprints, centred, estimates how many
pieces are in one text only, which gives `likeness`.

Null texts are empty ones; the fingerprint of a text without pieces is all zeros, and two such texts have likeness 1.
Ids may repeat: documents are ordered by (doc_id, text) descending, null ids last. A single row is its own next document.
Extra columns are left out. No group is collected: a text is hashed within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.llm.common import settle

SALTS = ("a", "b")
LANES = 64 * len(SALTS)
MODULUS = 1 << 16
_PAIR = (1 << 32) | 1
_RANGE = 1 << 40


def pieces(text: Column) -> Column:
    """Sentences of the lines of a text, without outer blanks."""
    cut = F.coalesce(text, F.lit(""))
    for end in ".!?":
        cut = F.replace(cut, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.filter(F.transform(F.split(cut, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def hashed(text: Column, which: int) -> Column:
    """The pieces as structs of `which` text they belong to and their two hashes."""
    return F.transform(pieces(text), lambda p: F.struct(F.lit(which).alias("w"), *[F.xxhash64(F.lit(s), p).alias(s) for s in SALTS]))


def vectors(rows: DataFrame, keys: list[str], texts: list[Column]) -> DataFrame:
    """The columns `keys`, which tell rows apart, with v0, v1, ...: the fingerprint of each text as an array.

    A fingerprint is the number of pieces, then 128 lanes. Pieces are summed in the tasks that cut them, so one row of
    sums is shuffled for each document. Bits k and k + 32 of a hash are added as the halves of one long: a lane has 31 bits before it is
    reduced, more than a text can have pieces.
    """
    found = rows.select(*keys, F.concat(*[hashed(t, i) for i, t in enumerate(texts)]).alias("found"))
    found = found.select(*keys, F.explode_outer("found").alias("piece")).select(*keys, "piece.w", *[f"piece.{s}" for s in SALTS])
    none = F.lit(0).cast("long")
    sums = [F.count_if(F.col("w") == i).alias(f"_n{i}") for i in range(len(texts))]
    for i in range(len(texts)):
        for s in SALTS:
            own = F.when(F.col("w") == i, F.col(s)).otherwise(none)
            sums += [F.sum(F.shiftrightunsigned(own, k).bitwiseAND(F.lit(_PAIR))).alias(f"_{i}{s}{k}") for k in range(32)]
    added = found.groupBy(*keys).agg(*sums)
    out = []
    for i in range(len(texts)):
        lanes = [F.col(f"_n{i}").cast("int")]
        for s in SALTS:
            lanes += [F.col(f"_{i}{s}{k}").bitwiseAND(F.lit(MODULUS - 1)).cast("int") for k in range(32)]
            lanes += [F.shiftrightunsigned(f"_{i}{s}{k}", 32).bitwiseAND(F.lit(MODULUS - 1)).cast("int") for k in range(32)]
        out.append(F.array(*lanes).alias(f"v{i}"))
    return added.select(*keys, *out)


def _lane(i: int | Column) -> Column:
    return F.when(i == 0, F.lit(1 << 31)).otherwise(F.lit(MODULUS))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of the pieces of both: insertion."""
    return _reduced(F.zip_with(a, b, lambda x, y: x.cast("long") + y))


def without(a: Column, b: Column) -> Column:
    """Fingerprint of the pieces of `a` less those of `b`: deletion."""
    return _reduced(F.zip_with(a, b, lambda x, y: x.cast("long") - y))


def _reduced(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.pmod(x, _lane(i)).cast("int"))


def as_text(v: Column) -> Column:
    """8 hex digits of the number of pieces, then 4 for each lane."""
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(x), F.when(i == 0, 8).otherwise(4), F.lit("0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of pieces two texts have in common, 2 |A and B| / (|A| + |B|), as estimated from their fingerprints, 0 to 1.

    With bits as lanes, 2 * (difference of lane sums) - (difference of counts) is a sum of one sign for each piece in one
    text only; its mean square over the lanes estimates their number.
    """

    def centred(x: Column, y: Column, i: Column, d: Column) -> Column:
        diff = F.pmod(x.cast("long") - y + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(2 * diff - d)

    d = F.get(a, F.lit(0)).cast("long") - F.get(b, F.lit(0))
    total = F.get(a, F.lit(0)).cast("long") + F.get(b, F.lit(0))
    signs = F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: centred(p["x"], p["y"], i, d))
    squares = F.aggregate(signs, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e)
    alone = squares / LANES
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - alone / total))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Adds `row`, a number for each row, and `next`, a struct of `row` and `columns` of the next row by descending id
    (after the last: of the first).

    Rows are cut into ranges of ids, and each range also receives the first rows of the range that follows it, so a window
    over one range sees every neighbour. Range bounds are quantiles: their number is bounded, and no range holds a third.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_id", F.col(doc_id).cast("long"))
    ranges = partitions or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.agg(
        F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], F.lit(100 * ranges)).alias("cuts"),
    ).first()
    cuts = sorted(set(ids["cuts"] or []))
    # Ranges run downwards: 0 holds the largest ids, the last one the smallest, and null ids with them.
    n = len(cuts) + 1
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    place = F.when(F.col("_id").isNull(), F.lit(n - 1)).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("_id"))))
    rows = rows.withColumn("_range", place)
    tops = rows.groupBy("_range").agg(F.max("_id").alias("_top")).orderBy("_range").collect()
    if not tops:
        return rows.select(*docs.columns, F.lit(0).cast("long").alias("row"), F.struct(F.lit(0).cast("long").alias("row"), *columns).alias("next"))
    # The range before each non-empty one; the first follows the last.
    before = {t["_range"]: tops[i - 1]["_range"] for i, t in enumerate(tops)}
    top = F.create_map(*[F.lit(x) for t in tops for x in (t["_range"], t["_top"])])
    back = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    is_top = F.col("_id").eqNullSafe(F.element_at(top, F.col("_range")))
    copies = F.when(is_top, F.array(F.struct(F.col("_range").alias("to"), F.lit(0).alias("late")), F.struct(F.element_at(back, F.col("_range")).alias("to"), F.lit(1).alias("late"))))
    copies = copies.otherwise(F.array(F.struct(F.col("_range").alias("to"), F.lit(0).alias("late"))))
    # Plain columns, so that both windows are seen to share one exchange.
    rows = rows.withColumn("_copy", F.explode(copies)).withColumns({"_to": F.col("_copy.to"), "_late": F.col("_copy.late")}).drop("_copy")
    order = Window.partitionBy("_to").orderBy("_late", F.col("_id").desc_nulls_last(), F.col(text).desc_nulls_last())
    own = F.col("_range").cast("long") * _RANGE
    rows = rows.withColumn("_at", F.row_number().over(order))
    # A copy is a first row of its own range; among rows of one id and text it does not matter which one is meant.
    here = F.when(F.col("_late") == 0, own + F.col("_at")).otherwise(own + 1)
    rows = rows.withColumn("row", here)
    rows = rows.withColumn("next", F.lead(F.struct("row", *columns)).over(order)).filter("_late = 0")
    return rows.select(*docs.columns, "row", "next")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the next document's beginning, and likeness."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, ["text"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select("doc_id", "row", F.col("next.row").alias("next_row"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    done = settle(vectors(rows, ["row", "next_row", "doc_id", "n_chars", "edited_sha256"], [F.col("text"), F.col("edited")]), "fingerprints")
    after = done.select(F.col("row").alias("next_row"), F.col("v0").alias("next_v"))
    return done.join(after, "next_row").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v0")).alias("fingerprint"), as_text(F.col("v1")).alias("edited_fingerprint"),
        likeness(F.col("v0"), F.col("v1")).alias("near_edited"), likeness(F.col("v0"), F.col("next_v")).alias("near_next"),
    )
