"""The queries of this subpackage, over whole tables, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_lines, op2_rules, op3_jaccard, op4_secrets, op5_kdtree, op6_quality, op7_language, op8_packing, op9_substring, op10_bpe, op11_toxicity, op12_whitening, op13_phrases


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def _count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_secrets.scan(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [_count_of("assign"), _count_of("access"), _count_of("hex")]
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_kdtree.top_k(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_language.identify(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op9_substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join("ids", ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A sum of squares beyond 64 bits is null here; the operator has it as a decimal.
    return op12_whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_phrases.collocations(_table(spark, sf_dir, "documents"))


#: Words of a text; the lower-casing of A-Z alone.
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = (("a", "base_failed"), ("b", "10 * n_symbols > word_chars"), ("c", "n_dup_lines >= 5"))
_SUMS = ", ".join(f"sum(CAST({rule} AS DOUBLE)) AS f{k}" for k, rule in _RULES)
_MOMENTS = ", ".join(f"avg(f{k} / n) AS m{k}, var_pop(f{k} / n) - avg(f{k} / n) * (1 - avg(f{k} / n)) * avg(1.0 / n) AS v{k}" for k, _ in _RULES)
_PRIORS = ", ".join(f"m{k}, greatest(1.0, CASE WHEN v{k} > 0 THEN m{k} * (1 - m{k}) / v{k} - 1 ELSE size END) AS s{k}" for k, _ in _RULES)
_OK = " AND ".join(f"(f{k} + m{k} * s{k}) / (n + s{k}) <= m{k} + least(0.5 * (1 - m{k}), 3 * sqrt(m{k} * (1 - m{k}) / (s{k} + 1))) + 1e-12" for k, _ in _RULES)

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, {WORDS.format('text')} AS w FROM documents),
lines AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
dup AS (SELECT rid, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM lines GROUP BY rid),
win AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM win JOIN (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY rid),
m AS (SELECT d.doc_id, d.host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, {_SUMS} FROM b GROUP BY host),
q AS (SELECT avg(n) AS size, avg(1.0 / n) AS inv, {_MOMENTS} FROM h),
p AS (SELECT {_PRIORS} FROM q),
ok AS (SELECT host, {_OK} AS host_ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept
FROM b LEFT JOIN ok ON b.host IS NOT DISTINCT FROM ok.host
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
      UNION SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""

OP5_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid AND q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (SELECT win.doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g) WHERE win.doc_id > m),
cov AS (SELECT doc_id, list(DISTINCT i + k) AS c FROM gone, (SELECT unnest(range(13)) AS k) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word LEFT JOIN (SELECT doc_id, unnest(c) AS p, true AS hit FROM cov) h USING (doc_id, p) WHERE hit IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(c), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i:i + k - 1] AS p FROM g) GROUP BY lang, p),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2 AND f >= 30),
cut AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
s AS (SELECT cut.lang, cut.p, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1:k] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[k + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
part AS (SELECT lang, a, p, unnest(range(2, len(p))) AS k FROM c),
inside AS (SELECT lang, q, max(a) AS most FROM (SELECT lang, a, p[i:i + k - 1] AS q FROM (SELECT lang, a, p, k, unnest(range(1, len(p) - k + 2)) AS i FROM part)) GROUP BY lang, q),
kept AS (SELECT m.* FROM m LEFT JOIN inside ON inside.lang = m.lang AND inside.q = m.p WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, array_to_string(p, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_rules, op3_ngram_jaccard, op4_secret_scan, op5_exact_topk, op6_quality_classifier, op7_language_id, op8_best_fit_packing, op9_substring_dedup, op10_byte_bpe,
              op11_toxicity_lexicon, op12_embedding_whitening, op13_phrase_mining)
}
ORACLE_SQL = {"op2_quality_rules": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_exact_topk": OP5_SQL, "op9_substring_dedup": OP9_SQL, "op13_phrase_mining": OP13_SQL}
