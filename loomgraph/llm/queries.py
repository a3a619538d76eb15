"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import components, gram_classes, heavy_hitters, leakage, mixing, quality, term_frequency
from loomgraph.sources.tables import table

HEAVY_SHARE = "0.0025"
MATCH_SUBSETS = ["owl-same-as", "owl-equivalence-classes"]
RARE_RECORDS = 3
COMMON_SHARE = (1, 10)
TEXT_GRAMS = 2


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids in at least 0.25 % of the rows of ``triples`` whose o, or s, is not null."""
    return heavy_hitters.frequent_values(table(spark, d, "triples"), ["o", "s"], HEAVY_SHARE).select(
        "field_name", "val"
    )


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent ids of each of o and s with their counts."""
    t = table(spark, d, "triples")
    parts = [heavy_hitters.top_k(t, c, 100).select(F.lit(c).alias("field_name"), "val", "n") for c in ("o", "s")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every linked id of the two match subsets."""
    t = table(spark, d, "schema_triples").where(F.col("subset_name").isin(MATCH_SUBSETS))
    return components.connected_groups(t, "subset_name", "s", "o")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    return (
        p2_found(spark, d)
        .groupBy("subset_name", "group_id")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("subset_name", "members")
        .agg(F.count(F.lit(1)).alias("n_groups"))
    )


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    triples, patterns = table(spark, d, "triples"), table(spark, d, "query_patterns")
    p_records = triples.where("p IS NOT NULL").agg(F.countDistinct("s").alias("n")).first()["n"]
    q_records = patterns.agg(F.countDistinct("query_id").alias("n")).first()["n"]
    parts = []
    for field, df, value, record, total in (
        ("p", triples, "p", "s", p_records),
        ("explicit_estimate", patterns, "explicit_estimate", "query_id", q_records),
    ):
        f = term_frequency.value_frequencies(df, value, record)
        mark = F.when(F.col("records") < RARE_RECORDS, "too_rare").when(
            F.col("records") * COMMON_SHARE[1] > COMMON_SHARE[0] * total, "too_common"
        )
        parts.append(f.select(F.lit(field).alias("field_name"), "val", "occurrences", "records", mark.alias("mark")))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of ``triples.p`` and ``query_patterns.explicit_estimate`` that are too rare or too common."""
    return _frequencies(spark, d).where("mark IS NOT NULL").select("field_name", "val", "mark")


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every distinct value of the two columns."""
    return _frequencies(spark, d)


def p6_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every word and pair of words in a row of the notebooks' texts."""
    texts = table(spark, d, "documents").where("text IS NOT NULL")
    total = texts.count()
    f = term_frequency.ngram_frequencies(texts.select(term_frequency.words(F.col("text")).alias("words")), "words", TEXT_GRAMS)
    mark = F.when(F.col("records") < RARE_RECORDS, "too_rare").when(
        F.col("records") * COMMON_SHARE[1] > COMMON_SHARE[0] * total, "too_common"
    )
    return f.withColumn("mark", mark)


def p6_all_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every sequence of words, of any length, in the notebooks' texts.

    Sequences that stand at the same places are one row: those of ``n_from`` to ``n_to`` words from
    the ``word``-th word of ``doc_id``, the first place where they stand.
    """
    texts = table(spark, d, "documents").where("text IS NOT NULL")
    total = texts.count()
    f = gram_classes.ngram_classes(texts.select("doc_id", term_frequency.words(F.col("text")).alias("words")), "doc_id", "words")
    mark = F.when(F.col("records") < RARE_RECORDS, "too_rare").when(
        F.col("records") * COMMON_SHARE[1] > COMMON_SHARE[0] * total, "too_common"
    )
    return f.withColumnRenamed("record", "doc_id").withColumn("mark", mark)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(
        table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text"
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that contain a passage of an evaluation item, and the item."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The character ranges to remove from each document, with the items they come from."""
    return leakage.removal_spans(_leaks(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The notebooks of the targeted sources in training order, each use a row."""
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share, tokens and uses of every targeted source."""
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def _quality(spark: SparkSession, d: str) -> tuple[quality.Quality, quality.ShapeModel]:
    q = quality.Quality(table(spark, d, "documents"), "doc_id", "text", "lang")
    return q, q.fit(table(spark, d, "labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are mostly lists, tables or junk."""
    q, model = _quality(spark, d)
    return quality.shaped_documents(q.scores(model), model)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All statistics, the outlier score and the score of each shape for every document."""
    q, model = _quality(spark, d)
    return q.scores(model)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_top, p2_found, p2_sizes, p6_found, p6_frequencies, p6_ngrams, p6_all_ngrams,
            p7_found, p7_spans, p8_mixture, p8_shares, p9_found, p9_statistics,
        )
    }


_P1 = """
SELECT 'o' AS field_name, o AS val, count(*) AS n FROM triples WHERE o IS NOT NULL GROUP BY o
{o}
UNION ALL
SELECT 's' AS field_name, s AS val, count(*) AS n FROM triples WHERE s IS NOT NULL GROUP BY s
{s}"""

_P2 = """
WITH RECURSIVE links AS (
  SELECT subset_name, s AS a, o AS b FROM schema_triples
  WHERE subset_name IN ('owl-same-as', 'owl-equivalence-classes') AND s IS NOT NULL AND o IS NOT NULL
  UNION SELECT subset_name, o, s FROM schema_triples
  WHERE subset_name IN ('owl-same-as', 'owl-equivalence-classes') AND s IS NOT NULL AND o IS NOT NULL
), reach(subset_name, a, b) AS (
  SELECT subset_name, a, a FROM links
  UNION SELECT r.subset_name, r.a, l.b FROM reach r JOIN links l ON l.subset_name = r.subset_name AND l.a = r.b
), groups AS (SELECT subset_name, min(b) AS group_id, a AS member_id FROM reach GROUP BY subset_name, a)
"""

_P6 = """
WITH f AS (
  SELECT 'p' AS field_name, p AS val, count(*) AS occurrences, count(DISTINCT s) AS records,
         (SELECT count(DISTINCT s) FROM triples WHERE p IS NOT NULL) AS total
  FROM triples WHERE p IS NOT NULL GROUP BY p
  UNION ALL
  SELECT 'explicit_estimate', explicit_estimate, count(*), count(DISTINCT query_id),
         (SELECT count(DISTINCT query_id) FROM query_patterns)
  FROM query_patterns WHERE explicit_estimate IS NOT NULL GROUP BY explicit_estimate
), m AS (SELECT field_name, val, occurrences, records,
  CASE WHEN records < 3 THEN 'too_rare' WHEN records * 10 > total THEN 'too_common' END AS mark FROM f)
"""


def oracle_sql() -> dict:
    return {
        "p1_found": "SELECT field_name, val FROM ("
        + _P1.format(
            o="HAVING count(*) * 400 >= (SELECT count(o) FROM triples)",
            s="HAVING count(*) * 400 >= (SELECT count(s) FROM triples)",
        )
        + ")",
        "p1_top": "SELECT field_name, val, n FROM (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n DESC, val) AS k FROM ("
        + _P1.format(o="", s="")
        + ")) WHERE k <= 100",
        "p2_found": _P2 + "SELECT subset_name, group_id, member_id FROM groups",
        "p2_sizes": _P2
        + """SELECT subset_name, members, count(*) AS n_groups FROM (
  SELECT subset_name, group_id, count(*) AS members FROM groups GROUP BY 1, 2) GROUP BY 1, 2""",
        "p6_found": _P6 + "SELECT field_name, val, mark FROM m WHERE mark IS NOT NULL",
        "p6_frequencies": _P6 + "SELECT * FROM m",
        "p6_ngrams": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, 1 AS n, unnest(w) AS gram FROM d
  UNION ALL SELECT doc_id, 2, a || ' ' || b FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM d)
), f AS (SELECT gram, n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY gram, n)
SELECT *, CASE WHEN records < 3 THEN 'too_rare' WHEN records * 10 > (SELECT count(*) FROM d) THEN 'too_common' END AS mark FROM f""",
    }
