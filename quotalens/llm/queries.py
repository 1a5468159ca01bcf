"""Registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.llm import bpe, collocations, decontaminate, infill, language, licenses, neardup, pages, quality, secrets, substrings, topk, warc
from quotalens.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


@query
def op1_license_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, keep=["doc_id"])


@query
def op2_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    return found.select(
        "doc_id", *[secrets.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(secrets.KINDS[:3]).cast("binary"), 256).alias("base_sha256"), secrets.spans_text().alias("spans"),
        secrets.count_kind("token").alias("n_token"),
    )


@query
def op3_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = quality.fit_quality(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    return quality.score_quality(docs, net, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op4_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_substring_dedup(spark, folder):
    out = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.octet_length("kept").cast("long")
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT r, doc_id, unnest(range(strlen(x) // 2 - 49)) AS p, x FROM d WHERE doc_id IS NOT NULL AND strlen(x) >= 100
), s AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM p
), m AS (SELECT w, min(doc_id) AS least FROM s GROUP BY w
), g AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM s JOIN m USING (w) WHERE least < doc_id
), f AS (
  SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS span FROM g
), runs AS (SELECT r, span, min(p) AS a, max(p) + 50 AS b FROM f GROUP BY r, span
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM runs
), cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


@query
def op6_main_text(spark, folder):
    return pages.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_decontamination(spark, folder):
    return decontaminate.contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


ORACLES["op7_decontamination"] = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), ds AS (
  SELECT doc_id, w, list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' ')) AS s FROM d WHERE len(w) >= 5
), iss AS (
  SELECT item_id, w, list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' ')) AS s FROM i WHERE len(w) >= 5
), dx AS (SELECT doc_id, w, s, unnest(s) AS h, unnest(range(len(s))) AS pos FROM ds
), ix AS (SELECT DISTINCT item_id, w, s, unnest(s) AS h FROM iss
), win AS (
  SELECT doc_id, item_id, dx.w AS dw, ix.w AS iw, pos, dx.s[pos + 1:pos + len(ix.s)] AS a, ix.s AS b FROM dx JOIN ix USING (h)
), tag AS (
  SELECT doc_id, item_id, dw, iw, pos,
    list_transform(a, lambda x, k: x || ':' || len(list_filter(a[1:k], lambda y: y = x))) AS a,
    list_transform(b, lambda x, k: x || ':' || len(list_filter(b[1:k], lambda y: y = x))) AS b FROM win
), sim AS (
  SELECT doc_id, item_id, pos, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS similarity FROM tag
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos) AS r FROM sim WHERE similarity >= 0.8
)
SELECT doc_id, item_id, pos::BIGINT AS start_word, similarity FROM best WHERE r = 1
"""


@query
def op8_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = bpe.transcode(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select(
        "doc_id", F.col("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op10_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs)
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op11_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))


ORACLES["op11_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), x AS (
  SELECT lang, w, unnest(range(len(w))) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase FROM x, range(1, 6) r(k) WHERE i + k <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 100
), u AS (
  SELECT lang, phrase, a, s, unnest(range(1, k)) AS j FROM c
), b AS (
  SELECT u.lang, u.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM u JOIN t ON t.lang = u.lang JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(s[1:j], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(s[j + 1:], ' ')
), m AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS pick FROM b
), o AS (
  SELECT DISTINCT h.lang, inner_phrase FROM (
    SELECT c.lang, c.a, array_to_string(s[q + 1:q + z], ' ') AS inner_phrase FROM c, range(0, 4) r1(q), range(2, 5) r2(z) WHERE q + z <= k AND z < k
  ) h JOIN c i ON i.lang = h.lang AND i.phrase = inner_phrase WHERE 100 * h.a >= 100 * i.a
)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM m LEFT JOIN o ON o.lang = m.lang AND o.inner_phrase = phrase WHERE pick = 1 AND o.lang IS NULL
QUALIFY rank <= 2000
"""


@query
def op12_fill_in_middle(spark, folder):
    made = infill.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents
), u AS (
  SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90
      THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(w[greatest(a, b) + 1:], '') AS s FROM u
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


@query
def op13_warc(spark, folder):
    path = warc.archive_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    found = warc.records(warc.read_archives(spark, path, payloads=False))
    return found.select(
        warc.key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of("refers_to").alias("refers_to"))


ORACLES["op13_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS r,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS most FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN r > 1 AND strlen(html) >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r > 1 AND strlen(html) >= 1000 THEN most END AS refers_to
FROM p
"""
