"""Fields from the text of electricity bills, as column expressions over a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.scalars import MONTH_NAMES, bill_month_key

USER = "user_id"

# What the bills print, and how scans tend to garble it.
MONTH_PREFIXES = [
    "जाने|नेवार|jan", "फे|feb", "मार|mar", "एप|apr", "मे$|may", "जून|jun",
    "जुल|jul", "ऑग|आग|aug", "सप्|sep", "ऑक्|आक्|oct", "नो|nov", "डिस|dec",
]
SHORT_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_YEAR = r"([\p{L}\p{M}]{2,15})\s*[-–—]?\s*(20[0-9]{2})(?:\s+([0-9]{1,5})(?![0-9.]))?"
MONTH_LABEL = r"(?i)MONTH\s*OF"
MONTH_LABEL_REACH = 91
DATE = r"([0-9]{1,2})[-/.]([0-9]{2})[-/.](20[0-9]{2})"
AMOUNT_BOX = r"देयक\s+र\S*\s+र\S*[\s:;|]*([0-9]{2,7}[.,][0-9]{2})"
AMOUNT_AFTER_DATE = r"[0-9]{1,2}[-/.][0-9]{2}[-/.]20[0-9]{2}[\s\S]{0,500}?([0-9]{2,7}[.,][0-9]{2})(?![0-9])"
RUPEE_AMOUNT = r"Rs\.?\s*([0-9]{2,7}[.,][0-9]{2})"
METER_ROW = r"[0-9]+\s+[0-9]+[.,][0-9]{2}\s+([0-9]{1,5})\s+([0-9]{1,5}|[oO°])\s+([0-9]{1,5})"
SUMMARY_MARK = r"(?i)Units\s*Consumed"
SUMMARY_LABEL = r"(?i)Bill\s*Month"
SUMMARY_REACH = 701
SUMMARY_MONTH = r"(?i)\b(" + "|".join(SHORT_MONTHS) + r")[A-Z]*\s*[-–]?\s*([0-9]{2})(?![0-9])"
SUMMARY_UNITS = r"^\s*([0-9]{1,5})(?![0-9.])"
SUMMARY_PAYABLE = r"([0-9]{3,6})\.00(?![0-9])"
SUMMARY_TOTAL = r"(?i)Total\s+current\s+month\s+charges[^0-9]*([0-9]{3,6}\.[0-9]{2})"
GARBLED_RUPEE_LIMIT = 10000


def _group(text: Column, pattern: str, group: int) -> Column:
    """Captured text, null when the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def month_index(word: Column) -> Column:
    """Month of a word by its beginning, null for other words.

    No beginning is the beginning of another one, so a word has one candidate at most and one expression finds it.
    """
    beginning = F.regexp_extract(F.lower(word), "^(" + "|".join(MONTH_PREFIXES) + ")", 1)
    known = F.create_map(*[
        F.lit(x) for i, forms in enumerate(MONTH_PREFIXES) for form in forms.split("|") for x in (form.rstrip("$"), i + 1)
    ])
    return F.try_element_at(known, beginning)


def month_year_matches(text: Column) -> Column:
    """All "<month word> [-] <year> [number]" occurrences as array<struct<month, year, units>>."""
    found = F.regexp_extract_all(text, F.lit(MONTH_YEAR), F.lit(0))
    # A hit is a word, then the first digits are the year, then the units may follow: short patterns take it apart.
    return F.transform(found, lambda hit: F.struct(
        month_index(F.regexp_extract(hit, r"^[\p{L}\p{M}]+", 0)).alias("month"),
        F.regexp_extract(hit, "20[0-9]{2}", 0).cast("int").alias("year"),
        _group(hit, r"20[0-9]{2}\s+([0-9]+)$", 1).try_cast("double").alias("units"),
    ))


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    Exploding a one-element array keeps the optimizer from copying a chain of regular expressions into every place that
    reads its result.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_matches(df: DataFrame, text: Column, name: str) -> DataFrame:
    return evaluate_once(df, name, month_year_matches(text))


def with_bill_month(df: DataFrame, text: Column, name: str = "bill_month") -> DataFrame:
    """struct(month, year): the month-year near the "MONTH OF" label, else the first full date."""
    at = F.regexp_instr(text, F.lit(MONTH_LABEL))
    near = F.when(at > 0, F.substring(text, at, F.lit(MONTH_LABEL_REACH)))
    out = with_matches(df, near, "_near")
    out = evaluate_once(out, "_labelled", F.get(F.filter("_near", lambda m: m["month"].isNotNull()), F.lit(0)))
    out = evaluate_once(out, "_date", F.when(F.col("_labelled").isNull(), F.struct(
        _group(text, DATE, 2).cast("int").alias("month"), _group(text, DATE, 3).cast("int").alias("year"))))
    dated = F.when(F.col("_date.month").between(1, 12), F.col("_date"))
    found = F.coalesce(F.col("_labelled").dropFields("units"), dated)
    return evaluate_once(out, name, found).drop("_near", "_labelled", "_date")


def with_bill_cost(df: DataFrame, text: Column, name: str = "cost") -> DataFrame:
    """Amount: the labelled box, else the first amount after a date, else the median of the "Rs" amounts."""
    exact = F.coalesce(_number(_group(text, AMOUNT_BOX, 1)), _number(_group(text, AMOUNT_AFTER_DATE, 1)))
    out = evaluate_once(df, "_exact", exact)
    listed = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(RUPEE_AMOUNT), F.lit(1)), _number))
    out = evaluate_once(out, "_amounts", F.when(F.col("_exact").isNull(), listed))
    n = F.size("_amounts")
    low = F.get("_amounts", F.floor((n - 1) / 2).cast("int"))
    high = F.get("_amounts", F.floor(n / 2).cast("int"))
    return evaluate_once(out, name, F.coalesce("_exact", F.when(n > 0, (low + high) / 2))).drop("_exact", "_amounts")


def with_bill_units(df: DataFrame, text: Column, month: str = "bill_month", name: str = "consumption") -> DataFrame:
    """Units: the history line of the bill month, else the meter row whose units and adjustment add up to its total."""
    known = F.col(month).isNotNull()
    out = with_matches(df, F.when(known, text), "_hits")
    history = F.filter("_hits", lambda m: (
        (m["month"] == F.col(f"{month}.month")) & (m["year"] == F.col(f"{month}.year")) & m["units"].isNotNull()
    ))
    out = evaluate_once(out, "_history", F.get(history, F.lit(0))["units"])

    def reading(row: Column) -> Column:
        parts = F.split(F.regexp_replace(row, "[oO°]", "0"), r"\s+")
        return F.transform(F.slice(parts, -3, 3), lambda x: x.try_cast("double"))

    rows = F.when(known & F.col("_history").isNull(), F.regexp_extract_all(text, F.lit(METER_ROW), F.lit(0)))
    out = evaluate_once(out, "_rows", F.transform(rows, reading))
    adding_up = F.filter("_rows", lambda r: F.get(r, F.lit(0)) + F.get(r, F.lit(1)) == F.get(r, F.lit(2)))
    total = F.get(F.get(adding_up, F.lit(0)), F.lit(2))
    return evaluate_once(out, name, F.coalesce("_history", total)).drop("_hits", "_history", "_rows")


def with_summary_row(df: DataFrame, text: Column, name: str = "summary_row") -> DataFrame:
    """struct(month, year, cost, consumption) of the layout with a summary row; null without such a row."""
    near = F.substring(text, F.greatest(F.regexp_instr(text, F.lit(SUMMARY_LABEL)), F.lit(1)), F.lit(SUMMARY_REACH))
    out = evaluate_once(df, "_tail", near)
    out = evaluate_once(out, "_hit", _group(F.col("_tail"), SUMMARY_MONTH, 0))
    end = F.position(F.col("_hit"), F.col("_tail")) + F.length("_hit")
    out = evaluate_once(out, "_mark", F.struct(
        _group(F.col("_hit"), SUMMARY_MONTH, 1).alias("name"), _group(F.col("_hit"), SUMMARY_MONTH, 2).alias("year"),
        F.substring(F.col("_tail"), end, F.lit(SUMMARY_REACH)).alias("after")))
    after = F.col("_mark.after")
    out = evaluate_once(out, "_payable", _group(after, SUMMARY_PAYABLE, 1))
    payable = F.col("_payable")
    round_sum = payable.try_cast("double")
    garbled = (round_sum >= GARBLED_RUPEE_LIMIT) & payable.startswith("7")
    cost = F.coalesce(
        F.when(garbled, F.substring(payable, 2, 10).try_cast("double")).otherwise(round_sum),
        _group(text, SUMMARY_TOTAL, 1).try_cast("double"),
    )
    months = F.array(*[F.lit(m) for m in SHORT_MONTHS])
    row = F.when(F.col("_mark.name").isNotNull(), F.struct(
        F.array_position(months, F.upper("_mark.name")).cast("int").alias("month"),
        (F.col("_mark.year").cast("int") + 2000).alias("year"),
        cost.alias("cost"),
        _group(after, SUMMARY_UNITS, 1).try_cast("double").alias("consumption"),
    ))
    return evaluate_once(out, name, row).drop("_tail", "_hit", "_mark", "_payable")


def _with_fields(df: DataFrame, text: Column, name: str) -> DataFrame:
    """All fields of a text as struct `name`: the summary row if the text has one, else the labelled layout.

    Each parser sees only the texts it is meant for; the others are passed as null and cost nothing.
    """
    out = with_summary_row(df, F.when(text.rlike(SUMMARY_MARK), text), "_row")
    rest = F.when(F.col("_row").isNull(), text)
    out = with_bill_month(out, rest, "_month")
    out = with_bill_cost(out, rest, "_cost")
    out = with_bill_units(out, rest, "_month", "_units")
    plain = F.struct(
        F.col("_month.month").alias("month"), F.col("_month.year").alias("year"),
        F.col("_cost").alias("cost"), F.col("_units").alias("consumption"),
    )
    return evaluate_once(out, name, F.coalesce(F.col("_row"), plain)).drop("_row", "_month", "_cost", "_units")


def parse_bills(df: DataFrame, text: str = "text", second: str | None = None) -> DataFrame:
    """Bill month, amount and units of every text.

    `second` names a second reading of the same bill; it is appended and tried when the first one gave no units.
    """
    out = _with_fields(df, F.col(text), "_first")
    if second:
        retry = F.col("_first.consumption").isNull() & F.col("_first.month").isNotNull() & F.col(second).isNotNull()
        out = _with_fields(out, F.when(retry, F.concat_ws("\n", text, second)), "_again")
        out = evaluate_once(out.withColumnRenamed("_first", "_only"), "_first", F.when(
            F.col("_again.consumption").isNotNull(), F.col("_again")).otherwise(F.col("_only"))).drop("_only", "_again")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    label = F.concat_ws(" ", F.get(names, F.col("_first.month") - 1), F.col("_first.year").cast("string"))
    return out.withColumns({
        "bill_date": F.when(F.col("_first.month").isNotNull(), label),
        "cost": F.col("_first.cost"),
        "consumption": F.col("_first.consumption"),
    }).drop("_first")


def bill_rejects(parsed: DataFrame) -> DataFrame:
    """Bills with unreadable fields and the list of those fields."""
    gaps = F.filter(
        F.array(
            F.when(F.col("bill_date").isNull(), "bill month"), F.when(F.col("cost").isNull(), "amount"),
            F.when(F.col("consumption").isNull(), "units consumed"),
        ),
        lambda g: g.isNotNull(),
    )
    return parsed.withColumn("unreadable", gaps).filter(F.size("unreadable") > 0)


def bills_newest_first(bills: DataFrame) -> list[Column]:
    """Sort order of bills: bill month, newest first, unreadable months last."""
    return [F.desc_nulls_last(bill_month_key(F.col("bill_date")))]


def bill_comparison(bills: DataFrame) -> DataFrame:
    """Latest bill of each user next to the one before. A user has one bill per month, so groups are small."""
    newest = Window.partitionBy(USER).orderBy(*bills_newest_first(bills), "bill_date")
    ranked = bills.select(
        USER, "bill_date", "cost", F.lead("cost").over(newest).alias("previous_cost"),
        F.lead("bill_date").over(newest).alias("previous_date"), F.row_number().over(newest).alias("_rank"),
    )
    diff = F.col("cost") - F.col("previous_cost")
    positive = F.when(F.col("previous_cost") > 0, F.col("previous_cost"))
    return ranked.filter((F.col("_rank") == 1) & F.col("previous_date").isNotNull()).select(
        USER, F.col("bill_date").alias("latest_date"), "previous_date", diff.alias("cost_difference"),
        F.round(F.coalesce(diff / positive * 100, F.lit(0.0)), 1).alias("change_percent"),
        F.when(diff > 0, "higher").otherwise("lower").alias("direction"),
    )
