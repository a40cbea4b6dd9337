"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm_lm, jaccard_join, language_id, license_scan, line_dedup, mixing, pii, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    def keyed(spans, k):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), k(s).alias("k"), s["stop"].alias("stop")))

    names = F.array(*[F.lit(x) for x in (*pii.KINDS, "term")])
    everything = F.array_sort(F.concat(keyed(F.col("base"), lambda s: s["k"]), keyed(F.col("terms"), lambda s: F.lit(len(pii.KINDS)))))
    return found.select(
        "doc_id",
        *[count(k) for k in range(len(pii.KINDS))],
        F.sha2(F.array_join(pii.named(F.col("base"), pii.kind_of), ","), 256).alias("base_sha256"),
        F.array_join(pii.named(everything, lambda s: F.element_at(names, s["k"] + 1)), ",").alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.cascade(docs, measures=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_compared", "n_removed", F.array_join(F.col("kept_lines").cast("array<string>"), ",").alias("kept_lines")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_hmm_lm": op3_hmm_lm,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_mix": op7_mix,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op10_line_dedup": r"""
WITH ln AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS i, unnest(l) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
lw AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM ln),
big AS (SELECT doc_id, i, w, row_number() OVER (ORDER BY doc_id, i) AS k FROM lw WHERE len(w) > 0),
one AS (SELECT w, len(w) AS n, min(k) AS k FROM big GROUP BY w),
s AS (SELECT k, n, unnest(w) AS g FROM one),
p AS (SELECT a.k AS a, b.k AS b, a.n + b.n AS n, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
gone AS (SELECT DISTINCT b AS k FROM p WHERE 100 * c >= 80 * (n - c)),
r AS (SELECT doc_id, count(*) AS n_compared, count(CASE WHEN one.k IS NULL OR gone.k IS NOT NULL THEN 1 END) AS n_removed,
             string_agg(CASE WHEN one.k IS NOT NULL AND gone.k IS NULL THEN CAST(i AS VARCHAR) END, ',' ORDER BY i) AS kept
      FROM big LEFT JOIN one USING (k) LEFT JOIN gone USING (k) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_compared, 0) AS n_compared,
       coalesce(n_removed, 0) AS n_removed, coalesce(kept, '') AS kept_lines
FROM documents d LEFT JOIN r USING (doc_id)""",
}
