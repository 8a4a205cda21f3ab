"""The registered queries of the training-data operators (full tables, production parameters)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, divergence, importance, language_id, main_text, minhash, packing, substring, suffix_dedup, token_counts, toxicity, url_filter
from .common import crc_mod, read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per later copy of a passage of 50 words or more: its document, place, and the document that holds it earlier."""
    docs = read_table(spark, sf_dir, "documents")
    spans = suffix_dedup.repeated_spans(docs, length=50).select(suffix_dedup.id_of("did", "th").alias("doc_id"), F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start_word"), (F.col("s.stop") - F.col("s.start")).alias("n_words"), F.col("s.source").alias("earlier_doc_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), minhash.Config(words=4, percent=80)).drop("text_hash")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_rows(toxicity.labelled_rows(docs, labels, crc_mod(F.col("doc_id"), 3) != 1))
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


#: (verdict, host, path prefix) of op6.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(read_table(spark, sf_dir, "documents"), length=35))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(*language_id.language_sample(docs, crc_mod(F.col("doc_id"), 4) != 2))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(main_text.sample_sentences(pages)))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash": op3_minhash,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_substring": op7_substring,
    "op8_ann": op8_ann,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_main_text": op11_main_text,
    "op12_importance": op12_importance,
    "op13_divergence": op13_divergence,
}

WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

OP3_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p:p+3], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * shared >= 80 * (len(sa.sh) + len(sb.sh) - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id"""

OP7_SQL = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text,'')")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p+34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
hit AS (SELECT tok.doc_id, word, i, max(rep.p) OVER (PARTITION BY tok.doc_id ORDER BY i) AS last FROM tok LEFT JOIN rep ON rep.doc_id = tok.doc_id AND rep.p = i),
k AS (SELECT doc_id, count(*) FILTER (last > i - 35) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (coalesce(last <= i - 35, true)) AS kept FROM hit GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

#: crc32 of a word's UTF-8 bytes, from their hexadecimal digits, with the table of the reflected polynomial 0xEDB88320.
CRC_STEP = "list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)"

OP12_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
x AS (SELECT doc_id, unnest(ws) AS w FROM d),
tab AS (SELECT list({CRC_STEP} ORDER BY c) AS t FROM (SELECT unnest(range(256)) AS c)),
v AS (SELECT DISTINCT w FROM (SELECT w FROM x UNION ALL SELECT w FROM b)),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), CAST(i + 1 AS INT), 2))::BIGINT)), lambda a, y: xor(t[CAST((xor(a, y) & 255) + 1 AS INT)], a >> 8))) % 10000 AS k FROM v, tab),
ks AS (SELECT k, count(*) AS s FROM x JOIN h USING (w) GROUP BY 1), kt AS (SELECT k, count(*) AS t FROM b JOIN h USING (w) GROUP BY 1),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM ks FULL JOIN kt USING (k)),
m AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN h USING (w) JOIN g USING (k) GROUP BY 1),
z AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)"""

OP13_SQL = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
x AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + v.v) AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (kept.n + 1) // (v.n + v.v) AS q FROM kept JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

#: The others train models, follow links or call tokenizers; tests hold them against brute force.
SQL: dict[str, str] = {"op3_minhash": OP3_SQL, "op7_substring": OP7_SQL, "op12_importance": OP12_SQL, "op13_divergence": OP13_SQL}
