"""The numbered corpus queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evalloom.llm import decontamination, exact_dedup, language_id, line_dedup, packing, ppm, quality, sharding, simhash, token_alignment, toxicity, vector_codes, warc
from evalloom.llm.common import fold_of, table
from evalloom.plans.staging import spread

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table of fewer partitions than cores is dealt out over them."""
    return spread(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of folds 0 and 2 of 3 and scores every document."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1)
    return toxicity.classify(docs, toxicity.train(docs, labels)).withColumn("held_out", fold_of("doc_id", 3) == 1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir), percent=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), width=3, radius=2)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from folds other than 2 of 7 and scores every document."""
    held_out = fold_of("doc_id", 7) == 2
    return ppm.score_texts(documents(spark, sf_dir), ~held_out).withColumn("held_out", held_out)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=16)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, spread(table(spark, sf_dir, "pages")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from folds 0 and 2 of 3 (labelled and unlabelled rows) and scores every document."""
    docs, held_out = documents(spark, sf_dir), fold_of("doc_id", 3) == 1
    model = quality.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return quality.classify(docs, model).withColumn("held_out", held_out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), buckets=8, token_budget=16_384)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spread(table(spark, sf_dir, "embeddings")), parts=8, entries=16, rounds=6)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.cross_tokens(documents(spark, sf_dir), folder="/opt/tokenizers", a_file="byte_bpe_50k.json", b_file="piece_bpe_32k.model")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from folds other than 0 of 5 and identifies every document."""
    return language_id.language_id(documents(spark, sf_dir), fold_of("doc_id", 5) == 0)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_ppm": op5_ppm,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}

def lloyd_sql(rounds: int) -> str:
    """Codes and codebooks of ``op11`` in SQL: two common table expressions a round, all in integers."""
    apart = "list_sum(list_transform(list_zip(m.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = f"SELECT m.rid, m.p, min({apart} * 16 + c.e) AS v FROM member m JOIN book{{0}} c USING (p) GROUP BY m.rid, m.p"
    update = """SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM book{0} b LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
          SELECT p, v % 16 AS e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
            SELECT a.p, a.v, unnest(m.x) AS y, generate_subscripts(m.x, 1) AS i FROM near{0} a JOIN member m USING (rid, p)) GROUP BY ALL) GROUP BY p, e) u USING (p, e)"""
    steps = [f"near{r} AS MATERIALIZED ({assign.format(r)}), book{r + 1} AS MATERIALIZED ({update.format(r)})" for r in range(rounds)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS q
              FROM embeddings WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
     member AS MATERIALIZED (SELECT rid, p, q[p * len(q) // 8 + 1 : (p + 1) * len(q) // 8] AS x FROM kept, (SELECT unnest(range(8)) AS p)),
     book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM member WHERE rid <= 16),
     {", ".join(steps)},
     near{rounds} AS MATERIALIZED ({assign.format(rounds)}),
     coded AS (SELECT rid, string_agg(printf('%02x', (v % 16)::INT), '' ORDER BY p) AS code, sum(v // 16)::BIGINT AS error FROM near{rounds} GROUP BY rid),
     sha AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), sha
"""


ORACLE: dict[str, str] = {
    "op11_vector_codes": lloyd_sql(6),
    "op2_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split),
     word AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS k FROM line),
     class AS (SELECT k, len(k) AS n, row_number() OVER (ORDER BY min(doc_id::HUGEINT * 1000000000 + pos)) AS id, min(doc_id::HUGEINT * 1000000000 + pos) AS o
               FROM word WHERE len(k) > 0 GROUP BY k),
     token AS (SELECT id, n, unnest(k) AS tok FROM class),
     df AS (SELECT tok, count(*) AS df FROM token GROUP BY tok),
     ranked AS (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY df, tok) AS i FROM token JOIN df USING (tok)),
     prefix AS (SELECT * FROM ranked WHERE i <= n - (80 * n + 99) // 100 + 1),
     pair AS (SELECT DISTINCT x.id AS x, y.id AS y FROM prefix x JOIN prefix y ON x.tok = y.tok AND y.id < x.id AND least(x.n, y.n) * 100 >= 80 * greatest(x.n, y.n)),
     near AS (SELECT DISTINCT x FROM pair JOIN class a ON a.id = x JOIN class b ON b.id = y WHERE len(list_intersect(a.k, b.k)) * 180 >= 80 * (a.n + b.n)),
     judged AS (SELECT w.doc_id, w.pos, coalesce(c.o <> w.doc_id::HUGEINT * 1000000000 + w.pos OR s.x IS NOT NULL, false) AS removed
                FROM word w LEFT JOIN class c ON c.k = w.k LEFT JOIN near s ON s.x = c.id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT removed) AS n_kept, count(*) FILTER (removed) AS n_removed,
       coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (removed), '') AS removed_lines
FROM judged GROUP BY doc_id
""",
    "op7_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
     d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url, true AS verified
FROM d
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}
