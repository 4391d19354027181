"""Queries over corpus-scale jobs and user hooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evalloom.functions import hooks
from evalloom.operators import corpus as c
from evalloom.operators import prepare
from evalloom.operators import text_metrics as x
from evalloom.operators.postfilter import stop_at
from evalloom.plans.staging import spread
from evalloom.queries.generation import BLEU_SQL, altered
from evalloom.queries.registry import query, round6, table
from evalloom.queries.scoring import PPL_SQL, perplexity_rows

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
CASED = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x))"
HITS_SQL = f"""dw AS (SELECT doc_id, {CASED} AS w FROM documents), iw AS (SELECT item_id, {CASED} AS w FROM benchmark),
  dg AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS p FROM dw)),
  ig AS (SELECT DISTINCT item_id, array_to_string(w[p + 1:p + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS p FROM iw)),
  hits AS (SELECT doc_id, item_id, p FROM dg JOIN ig USING (g))"""


def hits(spark, sf):
    return c.contamination_hits(spread(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


@query("i1_contamination_hits", f"WITH {HITS_SQL} SELECT doc_id, item_id, count(*) AS places FROM hits GROUP BY ALL")
def i1(spark, sf):
    return hits(spark, sf).groupBy("doc_id", "item_id").agg(F.count("*").alias("places"))


@query("i1_contaminated_items", f"WITH {HITS_SQL}, n AS (SELECT item_id, count(DISTINCT doc_id) AS docs FROM hits GROUP BY item_id) SELECT item_id, docs IS NOT NULL AS contaminated, coalesce(docs, 0) AS docs FROM benchmark LEFT JOIN n USING (item_id)")
def i1_items(spark, sf):
    return c.contaminated_items(hits(spark, sf), table(spark, sf, "benchmark"))


@query("i2_clean_subset_scores", f"""WITH {HITS_SQL}, bad AS (SELECT DISTINCT item_id FROM hits), s AS (SELECT m AS model, b.item_id, ((b.item_id + m) % 3 = 0)::INTEGER AS value, bad.item_id IS NOT NULL AS bad FROM benchmark b LEFT JOIN bad USING (item_id), (SELECT unnest([0, 1]) AS m))
    SELECT model, round(avg(value), 6) AS value_all, count(*) AS n_all, round(avg(value) FILTER (NOT bad), 6) AS value_clean, count(*) FILTER (NOT bad) AS n_clean, round(avg(value) FILTER (bad), 6) AS value_contaminated, count(*) FILTER (bad) AS n_contaminated FROM s GROUP BY model""")
def i2(spark, sf):
    items = table(spark, sf, "benchmark")
    rows = items.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("model")).withColumn("value", ((F.col("item_id") + F.col("model")) % 3 == 0).cast("int"))
    out = c.clean_subset_scores(rows, c.contaminated_items(hits(spark, sf), items))
    return out.select("model", *[round6(F.col(k)).alias(k) if k.startswith("value") else F.col(k) for k in out.columns if k != "model"])


@query("i3_mask_corpus_drop", f"WITH {HITS_SQL} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def i3(spark, sf):
    return c.mask_corpus(table(spark, sf, "documents"), hits(spark, sf)).select("doc_id", "lang")


@query("i3_mask_corpus_cut", rf"""WITH {HITS_SQL}, cov AS (SELECT DISTINCT doc_id, p + k AS p FROM hits, (SELECT unnest(range(0, 13)) AS k)), bad AS (SELECT DISTINCT doc_id FROM hits),
    part AS (SELECT doc_id, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') AS gap, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS word FROM documents WHERE doc_id IN (SELECT doc_id FROM bad)),
    tok AS (SELECT doc_id, unnest(gap) AS gap, generate_subscripts(gap, 1) - 1 AS p, word FROM part),
    told AS (SELECT tok.doc_id, tok.p, gap, coalesce(word[tok.p + 1], '') AS word, cov.p IS NOT NULL AS here, lag(cov.p IS NOT NULL, 1, false) OVER (PARTITION BY tok.doc_id ORDER BY tok.p) AS before FROM tok LEFT JOIN cov ON cov.doc_id = tok.doc_id AND cov.p = tok.p),
    cut AS (SELECT doc_id, string_agg(CASE WHEN here AND before THEN '' WHEN here THEN gap ELSE gap || word END, '' ORDER BY p) AS t FROM told GROUP BY doc_id)
    SELECT d.doc_id, md5(coalesce(t, d.text)) AS digest FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id""")
def i3_cut(spark, sf):
    return c.mask_corpus(table(spark, sf, "documents"), hits(spark, sf), "cut").select("doc_id", F.md5("text").alias("digest"))


STACK_SQL = """st AS (SELECT doc_id % 20 AS bucket, doc_id, left(text, 4000) AS text FROM documents),
  us AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY bucket ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
  hs AS (SELECT bucket, left(string_agg(text, ' ' ORDER BY doc_id), 4000) AS h FROM us WHERE before < 4000 GROUP BY bucket)"""


NEEDLE_SQL = """j AS (SELECT bucket, h, nd, len(nd) AS k, length(h) AS n FROM hs JOIN nd USING (bucket))
    SELECT bucket, array_to_string(list_transform(range(1, k + 2), lambda i: substring(h, (n * (i - 1) // (k + 1)) + 1, (n * i // (k + 1)) - (n * (i - 1) // (k + 1)))
      || coalesce(' The special number for ' || nd[i].key || ' is ' || nd[i].value || '. ', '')), '') AS prompt,
    'What are all the special numbers for ' || array_to_string(list_sort(list_distinct(list_transform(list_filter(nd, lambda s: s.asked), lambda s: s.key))), ', ') || '?' AS question,
    array_to_string(list_transform(list_filter(nd, lambda s: s.asked), lambda s: s.value), ',') AS answers FROM j"""


@query("i4_needle_dataset", f"WITH {STACK_SQL}, nd AS (SELECT item_id % 20 AS bucket, list_sort(list({{'key': 'key-' || (item_id // 40), 'value': left(md5(text), 8), 'asked': item_id % 40 < 20}})) AS nd FROM benchmark GROUP BY 1), {NEEDLE_SQL}")
def i4(spark, sf):
    needles = table(spark, sf, "benchmark").select(
        (F.col("item_id") % 20).alias("bucket"), F.concat(F.lit("key-"), F.floor(F.col("item_id") / 40).cast("string")).alias("key"), F.substring(F.md5("text"), 1, 8).alias("value"), (F.col("item_id") % 40 < 20).alias("asked")
    )
    made = c.needle_dataset(c.haystacks(table(spark, sf, "documents"), F.col("doc_id") % 20, 4000), needles)
    return made.withColumn("answers", F.array_join("answers", ","))


def variant_sql(variant):
    key = "min(key) OVER (PARTITION BY bucket)" if variant == "multivalue" else "key"
    return f"""WITH {STACK_SQL}, pool AS (SELECT item_id % 20 AS bucket, 'key-' || item_id AS key, left(md5(text), 8) AS value FROM benchmark),
    pk AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, value) AS p FROM pool), few AS (SELECT bucket, {key} AS key, value, {"p = 1" if variant == "multikey" else "true"} AS asked FROM pk WHERE p <= {1 if variant == "single" else 4}),
    nd AS (SELECT bucket, list_sort(list({{'key': key, 'value': value, 'asked': asked}})) AS nd FROM few GROUP BY 1), {NEEDLE_SQL}"""


def variant_query(variant):
    def run(spark, sf):
        pool = table(spark, sf, "benchmark").select((F.col("item_id") % 20).alias("bucket"), F.concat(F.lit("key-"), F.col("item_id").cast("string")).alias("key"), F.substring(F.md5("text"), 1, 8).alias("value"))
        made = c.needle_dataset(c.haystacks(table(spark, sf, "documents"), F.col("doc_id") % 20, 4000), c.needles(pool, variant))
        return made.withColumn("answers", F.array_join("answers", ","))

    return run


for _variant in c.NEEDLE_VARIANTS:
    query(f"i4_needle_{_variant}", variant_sql(_variant))(variant_query(_variant))


TOP_SQL = f"""wc AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS p FROM wc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 60)"""
LIST_SQL = "SELECT lang, string_agg(w, ' ' ORDER BY md5(w || '#' || c), w) AS prompt, (SELECT string_agg(t.w, ',' ORDER BY t.p) FROM top t WHERE t.lang = r.lang AND t.p <= {0}) AS answers FROM r GROUP BY lang"


@query("i5_common_words_dataset", f"WITH {TOP_SQL}, r AS (SELECT lang, w, unnest(range(1, CASE WHEN p <= 10 THEN 31 ELSE 4 END)) AS c FROM top) {LIST_SQL.format(10)}")
def i5(spark, sf):
    return c.common_words_dataset(table(spark, sf, "documents"), "lang").withColumn("answers", F.array_join("answers", ","))


@query("i5_frequent_words_dataset", f"WITH {TOP_SQL}, r AS (SELECT lang, w, unnest(range(1, 1 + greatest(120 // (p * p), 1))) AS c FROM top) {LIST_SQL.format(3)}")
def i5_frequent(spark, sf):
    return c.frequent_words_dataset(table(spark, sf, "documents"), "lang").withColumn("answers", F.array_join("answers", ","))


@query("i6_distractor_qa_dataset", """WITH pl AS (SELECT doc_id, text AS passage, md5(doc_id::VARCHAR) AS m, doc_id % 64 AS b FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 64 ORDER BY md5(doc_id::VARCHAR), doc_id) <= 5),
    nr AS (SELECT i.item_id, i.text AS gold, m, passage FROM benchmark i JOIN pl ON b = i.item_id % 64 AND doc_id <> i.item_id QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY m, passage) <= 4),
    al AS (SELECT item_id, gold, m, passage FROM nr UNION ALL SELECT DISTINCT item_id, gold, md5('gold' || item_id), gold FROM nr),
    li AS (SELECT item_id, gold, list(passage ORDER BY m, passage) AS ps FROM al GROUP BY ALL)
    SELECT item_id, array_to_string(ps, chr(10)) AS prompt, list_position(ps, gold)::INTEGER AS gold_place FROM li""")
def i6(spark, sf):
    return c.distractor_qa_dataset(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 4)


@query("i7_variable_tracking_dataset", """WITH v AS (SELECT doc_id, list_transform([0, 1], lambda k: list_transform([0, 1, 2, 3, 4], lambda h: 'V' || upper(left(md5(doc_id || '-' || k || '-' || h), 5)))) AS nm, list_transform([0, 1], lambda k: ((doc_id * 7919 + k * 104729) % 90000 + 10000)::VARCHAR) AS vl FROM documents)
    SELECT doc_id, array_to_string(flatten(list_transform([1, 2, 3, 4, 5], lambda h: list_transform([1, 2], lambda k: 'VAR ' || nm[k][h] || ' = ' || CASE WHEN h = 1 THEN vl[k] ELSE 'VAR ' || nm[k][h - 1] END))), chr(10)) AS prompt,
    'Which variables are assigned the value ' || vl[1] || '?' AS question, array_to_string(nm[1], ',') AS answers FROM v""")
def i7(spark, sf):
    return c.variable_tracking_dataset(table(spark, sf, "documents"), "doc_id").withColumn("answers", F.array_join("answers", ","))


@query("i8_domain_perplexity", f"WITH {PPL_SQL} SELECT task AS source, round(exp(-sum(loglik) / sum(words)), 4) AS word_perplexity, round(exp(-sum(loglik) / sum(bytes)), 6) AS byte_perplexity, round(-sum(loglik) / (sum(bytes) * ln(2)), 6) AS bits_per_byte FROM r GROUP BY task")
def i8(spark, sf):
    out = c.domain_perplexity(perplexity_rows(spark, sf).withColumnRenamed("task", "source"))
    return out.select("source", F.round("word_perplexity", 4).alias("word_perplexity"), round6(F.col("byte_perplexity")).alias("byte_perplexity"), round6(F.col("bits_per_byte")).alias("bits_per_byte"))


@query("i9_length_curve", "SELECT source, round(avg(doc_id % 10) FILTER (n_chars <= 1024), 6) AS up_to_1024, round(avg(doc_id % 10) FILTER (n_chars > 1024 AND n_chars <= 4096), 6) AS up_to_4096, round(avg(doc_id % 10) FILTER (n_chars > 4096 AND n_chars <= 1000000), 6) AS up_to_1000000 FROM documents GROUP BY source")
def i9(spark, sf):
    rows = table(spark, sf, "documents").select("source", "n_chars", (F.col("doc_id") % 10).alias("value"))
    out = c.length_curve(rows, "n_chars", [1024, 4096, 1_000_000], ["source"])
    return out.select("source", *[round6(F.col(k)).alias(k) for k in out.columns if k != "source"])


EMAIL, MESSENGER, PHONE = (p.replace("'", "''") for p in c.CONTACTS.values())


@query("i10_redact_contacts", f"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '{MESSENGER}', '[MESSENGER]', 'g') AS t2 FROM a)
    SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) + len(regexp_extract_all(t1, '{MESSENGER}')) + len(regexp_extract_all(t2, '{PHONE}')) AS contacts, md5(regexp_replace(t2, '{PHONE}', '[PHONE]', 'g')) AS digest FROM b""")
def i10(spark, sf):
    return c.redact_contacts(table(spark, sf, "documents")).select("doc_id", F.col("contacts").cast("long").alias("contacts"), F.md5("text").alias("digest"))


@query("j1_register_metric", "SELECT lang, round(avg(CASE WHEN n_chars > 0 THEN length(text) - length(replace(text, 'e', '')) END), 6) AS letter_e, max(len(string_split(text, chr(10)))) AS most_lines FROM documents GROUP BY lang")
def j1(spark, sf):
    hooks.register_metric("letter_e", lambda df: F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit(""))), lambda v: round6(F.avg(v)))
    hooks.register_metric("most_lines", lambda df: F.size(F.split("text", "\n")).cast("long"), F.max)
    return hooks.evaluate(table(spark, sf, "documents"), ["letter_e", "most_lines"], ["lang"])


class MedianOfMeans:
    """Median of the means of 16 blocks of rows: a state of 16 sums and counts."""

    columns = ("block", "value")

    @staticmethod
    def update(state, rows):
        known = rows.dropna()
        np.add.at(state, (0, known["block"].to_numpy(int)), known["value"].to_numpy(float))
        np.add.at(state, (1, known["block"].to_numpy(int)), 1)
        return state

    @staticmethod
    def finish(state):
        held = state[1] > 0
        return float(np.median(state[0][held] / state[1][held])) if held.any() else None


@query("j1_mergeable_aggregate", "WITH b AS (SELECT CASE WHEN lang <> 'es' THEN lang END AS lang, doc_id % 16 AS block, avg(n_chars) AS m, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, round(median(m), 6) AS middle, sum(n)::BIGINT AS docs FROM b GROUP BY lang")
def j1_mergeable(spark, sf):
    """Median of means by language, where one language is null."""
    rows = table(spark, sf, "documents").select(F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), (F.col("doc_id") % 16).alias("block"), F.col("n_chars").alias("value"))
    hooks.register_aggregate("middle", hooks.Aggregate(MedianOfMeans.columns, lambda: np.zeros((2, 16)), MedianOfMeans.update, lambda a, b: a + b, MedianOfMeans.finish))
    hooks.register_metric("docs", lambda df: F.lit(1), F.count)
    out = hooks.evaluate(rows, ["middle", "docs"], ["lang"])
    return out.withColumn("middle", round6(F.col("middle")))


@query("j2_task_hook", "SELECT doc_id, upper(lang) AS task FROM documents WHERE length(text) >= 500")
def j2(spark, sf):
    docs = hooks.task_hook(table(spark, sf, "documents"), lambda d: prepare.filter_length(d, "text", 500, 1 << 30), lambda d: d.withColumn("task", F.upper("lang")))
    return docs.select("doc_id", "task")


@query("w2_generation", f"WITH {BLEU_SQL}, t AS (SELECT task, n, sum(hit) AS hit, sum(total) AS total, sum(pl) AS pl, sum(rl) AS rl FROM s GROUP BY ALL) SELECT task, round(CASE WHEN min(hit) = 0 THEN 0.0 ELSE exp(sum(ln(greatest(hit, 1)::DOUBLE / total)) / 4 + least(0.0, 1 - max(rl)::DOUBLE / max(pl))) END, 6) AS bleu FROM t GROUP BY task")
def w2(spark, sf):
    """Generations cut at a stop string and scored as a corpus per language."""
    docs = spread(table(spark, sf, "documents"))
    rows = docs.select(F.col("lang").alias("task"), stop_at(F.concat("text", F.lit("</s> more")), ["</s>"]).alias("pred"), altered(F.col("text")).alias("ref"))
    return x.bleu(rows, "pred", "ref", ["task"]).withColumn("bleu", round6(F.col("bleu")))
