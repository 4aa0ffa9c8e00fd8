"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_text, line_dedup, mixing, near_dedup, pieces, pii, quality, topk, toxicity, warc, whitening
from ._sample import remainder
from ._store import drop, new_path, stage

#: The vocabulary file of the registered query and the pipeline; both take another as an argument.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: For the registered query only; a real job gets its key from a secret store.
PII_KEY = "registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and rereads the archives; the records read back, without payloads, are kept for both uses of them."""
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    records, _ = stage(warc.read_archives(spark, path, with_payload=False).drop("payload", "archive"), "records")
    drop(spark, path)
    d = warc.page_digests(records)
    return d.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """The three best segmentations of every document: scores, digests of the ids, and whether the best decodes to the text."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), pieces.read_model(spark, model_file), n_best=3)


def _scored(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model).drop("text"), 4, 2)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, those dropped, and the text that is left."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is contaminated, the items found in it, and the words of the longest overlap."""
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.col("overlaps")
    return found.select(
        "doc_id",
        (F.size(hits) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(hits["item_id"])).alias("item_ids"),
        F.size(hits).alias("n_overlaps"),
        F.coalesce(F.array_max(hits["n_words"]), F.lit(0)).alias("longest_words"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model).drop("text"), 5, 0)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the numbers of values by kind."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
e AS (
  SELECT page_id, n, h, first_id,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT) // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32)::INT + 1, 1)), '') AS digest
  FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM e
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN m ON m.id = s.doc_id
"""

OP5_SQL = """
WITH l AS (
  SELECT doc_id, n - 1 AS no, line, row_number() OVER (ORDER BY doc_id, n) AS place
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)
  WHERE length(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0),
f AS (SELECT line, min(place) AS first, length(line) AS c FROM l GROUP BY line),
h AS (
  SELECT DISTINCT line, first, c, kind, len, CASE kind WHEN 'p' THEN left(line, len) ELSE right(line, len) END AS half
  FROM (SELECT *, unnest(['p', 's', 'p', 's']) AS kind, unnest([c // 2, c // 2, (c - 1) // 2, (c - 1) // 2]) AS len FROM f WHERE c >= 16)),
near AS (
  SELECT DISTINCT a.line FROM h a JOIN h b ON a.kind = b.kind AND a.len = b.len AND a.half = b.half AND b.first < a.first
  WHERE abs(a.c - b.c) <= 1 AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.no FROM l JOIN f USING (line) LEFT JOIN near USING (line) WHERE l.place <> f.first OR near.line IS NOT NULL)
SELECT d.doc_id, coalesce(string_agg(u.line, chr(10) ORDER BY u.n) FILTER (g.no IS NULL), '') AS text,
  count(*)::INT AS n_lines, count(g.no)::INT AS n_dropped
FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, n)
LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.no = u.n - 1
GROUP BY d.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, 1 + least(5, len(w) - i + 1)), lambda k: w[i : i + k - 1])))) AS p FROM w),
f AS (SELECT lang, p, count(*)::BIGINT AS f FROM g GROUP BY lang, p HAVING count(*) >= 100),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN t USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest(list_distinct(flatten(list_transform(range(2, len(p)), lambda m: list_transform(range(1, len(p) - m + 2), lambda i: p[i : i + m - 1]))))) AS p, f FROM f WHERE len(p) > 2),
inner_of AS (SELECT lang, p, max(f) AS f FROM longer GROUP BY lang, p),
o AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score
  FROM b LEFT JOIN inner_of i ON i.lang = b.lang AND i.p = b.p WHERE i.f IS NULL OR 100 * i.f < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_warc, op2_sentencepiece, op3_toxicity, op4_near_dedup, op5_line_dedup, op6_html, op7_decontamination, op8_quality, op9_topk, op10_pii, op11_collocations, op12_mixing, op13_whitening)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_near_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op9_topk": OP9_SQL, "op11_collocations": OP11_SQL}
