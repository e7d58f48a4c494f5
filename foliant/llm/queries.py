"""Queries of the text operators over the tables of a directory, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import languages, leaks, lookalike, markup, mixing, repetition, scans, truncation
from foliant.sources.tables import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), F.lit(-1).alias("idx"), "source", F.lit(None).cast("string").alias("label"), "lang", "text")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_element").filter("text is not null").select(F.lit("page_element").alias("tab"), F.col("page_id").alias("id"), F.col("elem_idx").alias("idx"), F.lit(None).cast("string").alias("source"), "label", F.lit(None).cast("string").alias("lang"), "text")


def _traces(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Traces with the source of their page; a trace delivered twice is judged once, by its key and value."""
    pages = table(spark, d, "page_image").select("page_id", "source")
    t = table(spark, d, "layout").filter(F.col(column).isNotNull()).select("page_id", F.col("elem_idx").alias("idx"), "label", F.col(column).alias("text"))
    return t.join(pages, "page_id", "left").select(F.lit("layout").alias("tab"), F.col("page_id").alias("id"), "idx", "source", "label", F.lit(None).cast("string").alias("lang"), "text")


def _keys(df: DataFrame, *more: str) -> DataFrame:
    return df.select("tab", F.col("id").cast("bigint").alias("rec_id"), F.col("idx").cast("bigint").alias("elem_idx"), *more).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with noise of scanned pages, by kind."""
    return _keys(scans.scan_noise(_documents(spark, d).unionByName(_elements(spark, d))), "kind")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every judged text as continuous paragraphs."""
    return _keys(scans.paragraphs(_documents(spark, d).unionByName(_elements(spark, d))), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and traces of which at least 30 % are repeated content."""
    return _keys(repetition.repetitive(_documents(spark, d).unionByName(_raw(spark, d))))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layout").select(F.lit("layout").alias("tab"), F.col("page_id").alias("id"), F.col("elem_idx").alias("idx"), F.lit(None).cast("string").alias("source"), "label", F.lit(None).cast("string").alias("lang"), F.col("raw").alias("text"))


def p2_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexities, verdict and repeated share of every text and trace."""
    return _keys(repetition.repetition(_documents(spark, d).unionByName(_raw(spark, d))), "lang", "tokens", "bits", "ratio", "share", "rejected")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tables with markup, by markup language."""
    docs = markup.residue(_documents(spark, d))
    cells = markup.residue(_traces(spark, d, "html"), table=True)
    one = lambda df, tab: df.select(F.lit(tab).alias("tab"), "id", "idx", F.explode("kinds").alias("kind"))
    return _keys(one(docs, "documents").unionByName(one(cells, "layout")), "kind")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every document with markup, its template removed."""
    return markup.clean_markup(_documents(spark, d)).select(F.col("id").alias("doc_id"), "source", "kinds", "n_template", "n_content", "clean")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).unionByName(_traces(spark, d, "html"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tables that were cut."""
    return _keys(truncation.truncated(_values(spark, d)))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its values."""
    return truncation.truncation_rates(_values(spark, d))


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits: lengths, under each measure, at which values of a source pile up."""
    return truncation.limits(truncation.lengths(_values(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are stored with different characters."""
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others stored differently, with their class and stored form."""
    return lookalike.lookalike_classes(table(spark, d, "documents"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every document's text."""
    return lookalike.canonical_texts(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "form", "changed")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_case").filter("axis = 'long_text'").select("case_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a held-out text, with the cases they hold."""
    return leaks.leaks(table(spark, d, "documents"), _cases(spark, d)).select("doc_id", "case_id")


def p6_cases(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each held-out text, and the largest share found."""
    return leaks.leaked_cases(table(spark, d, "documents"), _cases(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their target."""
    return _mixed(spark, d)[1].filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed selection: how often each chosen document is used."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the right label or of several languages, a row for each language."""
    return languages.mislabelled(table(spark, d, "documents"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every document with sentences, share and confidence."""
    return languages.document_languages(table(spark, d, "documents"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every document, each of one language with its confidence."""
    return languages.segment_languages(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_LIMITS = """WITH v AS (SELECT 'documents' AS tab, source, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'layout', p.source, l.html FROM layout l LEFT JOIN page_image p USING (page_id) WHERE html IS NOT NULL),
k AS (SELECT tab, source, length(t) AS chars, strlen(t) AS utf8, length(t) + len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')) AS utf16, length(t) - length(replace(t, chr(10), '')) AS nl, length(t) - length(replace(t, '&', '')) AS amp,
 2 * length(t) - length(replace(t, '<', '')) - length(replace(t, '>', '')) AS angle, length(t) - length(replace(t, '"', '')) AS quote, 2 * length(t) - length(replace(t, '\\', '')) - length(replace(t, chr(9), '')) AS other FROM v),
m AS (SELECT tab, source, unnest(['chars', 'utf8', 'utf16', 'entities', 'json', 'crlf']) AS measure, unnest([chars, utf8, utf16, chars + 4 * amp + 3 * angle + 5 * quote, chars + quote + other + nl, chars + nl]) AS length FROM k),
c AS (SELECT tab, source, measure, length, count(*) AS n FROM m GROUP BY ALL),
w AS (SELECT *, (sum(n) OVER (PARTITION BY tab, source, measure ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - n) / 50 AS mean, sum(n) OVER (PARTITION BY tab, source, measure) AS total FROM c)
SELECT tab, source, measure, CAST(length AS INT) AS "limit", n AS "values" FROM w WHERE n >= 4 AND n >= 5 * mean AND n >= 0.01 * total"""


def oracle_sql() -> dict[str, str]:
    """The limits are plain counts; the others cannot be written in SQL over the whole tables, tests/llm checks them by
    brute force."""
    return {"p4_limits": _LIMITS}
