"""Registered queries of the training-data operators, each over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.llm import (
    drift, langid, lexical, lines, mixing, multiset, packing, sharding, simhash, sql, substrings, tensored, tokenfiles, tokens, warc,
)
from gridmeter.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, from centroids of the documents that are not held out."""
    docs = documents(spark, folder)
    marked = docs.select("doc_id", "text", "lang", langid.is_held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(marked.filter(~F.col("held_out")))
    return langid.identify(marked, model, ["doc_id", "held_out"])


@query("op2_simhash_golay")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, folder), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_line_frequency", r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
      FROM (SELECT doc_id, source, unnest(lines) AS x FROM w)),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
often AS (SELECT f.source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL) f
          JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 50 AND f.n > 0.005 * h.n),
gone AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l
         JOIN often o ON o.line = l.line AND o.source IS NOT DISTINCT FROM l.source GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(len(words) - coalesce(g.n, 0) AS BIGINT) AS n_words_left
         FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_words_left < 20 OR n_words_left < 0.3 * n_words) AS kept, n_words_left
FROM base""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return lines.line_quality(documents(spark, folder))


@query("op4_multiset_hash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return multiset.edited_fingerprints(documents(spark, folder))


@query("op5_difference_cover")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document after passages went that a document with a smaller id has."""
    return substrings.remove_repeats(documents(spark, folder))


@query("op6_hypergeometric_shuffle")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """A uniform shuffle of all documents into 8 shards whose counts differ by one at most."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, folder).select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = sharding.assign(rows, 8, F.col("doc_id"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_histogram_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    pieces = packing.token_pieces(documents(spark, folder), tokens.vocabulary())
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op9_context_mixing_coder")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to files of coded blocks and read back."""
    return tokenfiles.read(tokenfiles.write(documents(spark, folder), tokens.vocabulary()))


@query("op10_warc_zstd", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return warc.read(warc.write(table(spark, folder, "pages")))


@query("op7_raked_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated probability of every document, whether it is drawn and how often."""
    found = mixing.sample(documents(spark, folder), mixing.document_dims(), mixing.document_tokens())
    out = found.select("row.doc_id", "by_source", "by_lang", "by_topic", "tokens", "weight", "probability", "kept", "copies")
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


@query("op11_drift_tightening", sql.clustering())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster and squared distance of every vector, after ten rounds from eight drawn centroids."""
    found, centroids = drift.cluster(table(spark, folder, "embeddings"))
    return drift.with_inertia(found, centroids)


@query("op12_tensored_minhash", sql.TENSORED)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's set of shingles, and its component of sets similar to 0.85 or more."""
    found = tensored.near_duplicates(documents(spark, folder))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op13_automaton_search", sql.LEXICAL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.rank(documents(spark, folder), table(spark, folder, "benchmark"))
