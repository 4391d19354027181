"""Queries over sources, item preparation, templates and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import template as t
from evalloom.operators import prepare as p
from evalloom.operators import requests as r
from evalloom.plans.staging import fresh_path
from evalloom.queries.registry import QUARTER_SQL, mc_responses, quarter, query, table
from evalloom.sources import tables as s

CHOICES_SQL = f"list_transform([0, 1, 2, 3], lambda i: {QUARTER_SQL})"


def four_choices() -> list:
    return [quarter(F.lit(i)) for i in range(4)]


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a split by identifier; French rows have no test split."""
    split = F.when(F.col("doc_id") % 3 == 2, "train").when((F.col("doc_id") % 3 == 1) | (F.col("lang") == "fr"), "validation").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task"), "text", split.alias("split"))


SPLIT_SQL = "s AS (SELECT doc_id, lang AS task, text, CASE WHEN doc_id % 3 = 2 THEN 'train' WHEN doc_id % 3 = 1 OR lang = 'fr' THEN 'validation' ELSE 'test' END AS split FROM documents)"


@query("a1_read_docs", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def a1(spark, sf):
    return s.read_docs(spark, f"{sf}/documents.parquet", "en", "src3", name_column="lang", split_column="source").select("doc_id", "lang", "source")


@query("a1_union_configs", "SELECT doc_id, lang, md5(text) AS digest, CASE WHEN lang = 'de' THEN n_chars END AS n_chars FROM documents WHERE lang IN ('de', 'fr')")
def a1_union(spark, sf):
    docs = table(spark, sf, "documents")
    return s.union_configs([docs.where("lang = 'de'"), docs.where("lang = 'fr'").drop("n_chars")]).select("doc_id", "lang", F.md5("text").alias("digest"), "n_chars")


@query("a2_eval_split", f"WITH {SPLIT_SQL} SELECT doc_id, task, split FROM s WHERE split = CASE WHEN task = 'fr' THEN 'validation' ELSE 'test' END")
def a2(spark, sf):
    return s.eval_split(split_docs(spark, sf)).select("doc_id", "task", "split")


@query("a2_fewshot_split", f"WITH {SPLIT_SQL} SELECT doc_id, task FROM s WHERE split = 'train'")
def a2_fewshot(spark, sf):
    return s.fewshot_split(split_docs(spark, sf)).select("doc_id", "task")


@query("a3_write_results", "SELECT lang AS task, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang")
def a3(spark, sf):
    path = fresh_path(spark, "results")
    s.write_results(table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", "n_chars"), path)
    return spark.read.parquet(path).groupBy("task").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query("a4_limit_docs", "SELECT doc_id, lang AS task FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def a4(spark, sf):
    return s.limit_docs(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("task")), 5)


@query("b1_filter_category", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def b1(spark, sf):
    return p.filter_category(table(spark, sf, "documents"), "source", "src3").select("doc_id", "lang")


@query("b1_category_tasks", "SELECT 'corpus_' || source AS task, count(*) AS n FROM documents GROUP BY 1")
def b1_tasks(spark, sf):
    return p.category_tasks(table(spark, sf, "documents"), "source", "corpus_").groupBy("task").agg(F.count("*").alias("n"))


@query("b2_filter_nonempty", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def b2(spark, sf):
    return p.filter_nonempty(table(spark, sf, "conversations"), "text").select("conv_id", "turn")


@query("b3_filter_length", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) >= 1000 AND length(text) < 2000")
def b3(spark, sf):
    return p.filter_length(table(spark, sf, "documents"), "text", 1000, 2000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("b4_filter_context_condition", "SELECT doc_id FROM documents WHERE n_chars <= 1000")
def b4(spark, sf):
    docs = table(spark, sf, "documents").withColumn("condition", F.when(F.col("n_chars") > 1000, "disambig").otherwise("ambig"))
    return p.filter_context_condition(docs, "condition", "ambig").select("doc_id")


@query("b5_pack_choices", f"SELECT doc_id, array_to_string({CHOICES_SQL}, '|') AS choices FROM documents")
def b5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", *[c.alias(f"option_{i}") for i, c in enumerate(four_choices())])
    return p.pack_choices(docs, [f"option_{i}" for i in range(4)]).select("doc_id", F.array_join("choices", "|").alias("choices"))


@query("b6_label_from_one_based", "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN (doc_id % 5)::INTEGER END AS label FROM documents")
def b6(spark, sf):
    docs = table(spark, sf, "documents").withColumn("answer", F.when(F.col("doc_id") % 5 < 4, (F.col("doc_id") % 5 + 1).cast("string")).otherwise("none"))
    return docs.select("doc_id", p.label_from_one_based("answer").alias("label"))


@query("b7_pick_choice", f"SELECT doc_id, ({CHOICES_SQL})[doc_id % 5 + 1] AS gold_text FROM documents")
def b7(spark, sf):
    docs = table(spark, sf, "documents").withColumn("choices", F.array(*four_choices()))
    return docs.select("doc_id", p.pick_choice("choices", (F.col("doc_id") % 5).cast("int")).alias("gold_text"))


@query("b8_map_label", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label, CASE lang WHEN 'en' THEN 'English' END AS name FROM documents")
def b8(spark, sf):
    docs = table(spark, sf, "documents").withColumn("code", F.col("doc_id") % 3)
    return docs.select("doc_id", p.map_label("code", {0: "entailment", 1: "neutral", 2: "contradiction"}).alias("label"), p.map_label("lang", {"en": "English"}, strict=False).alias("name"))


@query("b9_threshold_label", "SELECT l_orderkey, l_linenumber, (l_quantity + l_linenumber > 30)::INTEGER AS label FROM lineitem")
def b9(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.threshold_label("l_quantity", "l_linenumber", 30).alias("label"))


@query("b10_binary_label_from_value", "SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS label FROM documents")
def b10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", p.binary_label_from_value("lang", "en").alias("label"))


OPTIONS = " , ".join(f"{c} ) {{w{i}}}" for i, c in enumerate("abcde"))


@query(
    "b11_parse_options",
    r"""WITH o AS (SELECT doc_id, 'a ) ' || w[1] || ' , b ) ' || w[2] || ' , c ) ' || w[3] || ' , d ) ' || w[4] || ' , e ) ' || w[5] AS options
          FROM (SELECT doc_id, list_transform([1, 2, 3, 4, 5], lambda i: coalesce(string_split_regex(text, '[^a-zA-Z]+')[i], '')) AS w FROM documents))
        SELECT doc_id, array_to_string(list_transform(regexp_extract_all(options, '{0}'), lambda x: rtrim(substring(x, 5), ' ,')), '|') AS options FROM o""".replace("{0}", p.OPTIONS),
)
def b11(spark, sf):
    words = F.split("text", "[^a-zA-Z]+")
    docs = table(spark, sf, "documents").select("doc_id", *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(f"w{i}") for i in range(5)]).withColumn("options", t.render(OPTIONS))
    return docs.select("doc_id", F.array_join(p.parse_options("options"), "|").alias("options"))


@query("b12_pair_field", "SELECT item_id, reverse(text) AS target FROM benchmark")
def b12(spark, sf):
    items = table(spark, sf, "benchmark").withColumn("translation", F.create_map(F.lit("en"), "text", F.lit("rev"), F.reverse("text")))
    return items.select("item_id", p.pair_field("translation", "rev").alias("target"))


PAIRS_SQL = """pairs AS (SELECT a.item_id, a.lang AS src, b.lang AS tgt, a.t AS source_text, b.t AS target_text
  FROM wide a JOIN wide b ON a.item_id = b.item_id AND a.lang <> b.lang)"""
WIDE_SQL = "wide AS (SELECT item_id, 'en' AS lang, text AS t FROM benchmark UNION ALL SELECT item_id, 'rev', reverse(text) FROM benchmark UNION ALL SELECT item_id, 'cut', replace(text, ' ', '_') FROM benchmark)"


def parallel(spark, sf):
    wide = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t_en"), F.reverse("text").alias("t_rev"), F.replace("text", F.lit(" "), F.lit("_")).alias("t_cut"))
    return p.parallel_pairs(wide, "item_id", {"en": "t_en", "rev": "t_rev", "cut": "t_cut"})


@query("b13_select_direction", f"WITH {WIDE_SQL}, {PAIRS_SQL} SELECT * FROM pairs WHERE src = 'rev' AND tgt = 'en'")
def b13(spark, sf):
    return p.select_direction(parallel(spark, sf), "rev", "en")


@query("b14_parallel_pairs", f"WITH {WIDE_SQL}, {PAIRS_SQL} SELECT * FROM pairs")
def b14(spark, sf):
    return parallel(spark, sf)


@query(
    "b15_permute_choices",
    f"""WITH o AS (SELECT doc_id, doc_id % 4 AS gold, list_sort(list_transform([0, 1, 2, 3], lambda i: {{'k': sha256('7|' || doc_id || '|' || i), 'i': i, 'c': {QUARTER_SQL}}})) AS o FROM documents)
        SELECT doc_id, array_to_string(list_transform(o, lambda x: x.c), '|') AS choices, (list_position(list_transform(o, lambda x: x.i), gold) - 1)::INTEGER AS gold FROM o""",
)
def b15(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.array(*four_choices()).alias("choices"), (F.col("doc_id") % 4).cast("int").alias("gold"))
    return p.permute_choices(docs, 7).select("doc_id", F.array_join("choices", "|").alias("choices"), "gold")


@query("b16_minimal_pair", "SELECT item_id, text || '|' || reverse(text) AS choices, 0 AS gold FROM benchmark")
def b16(spark, sf):
    items = table(spark, sf, "benchmark").withColumn("bad", F.reverse("text"))
    return p.minimal_pair(items, "text", "bad").select("item_id", F.array_join("choices", "|").alias("choices"), "gold")


@query(
    "b17_turn_limits",
    """SELECT conv_id, turn, role FROM conversations
       WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
       QUALIFY count(*) FILTER (role = 'user') OVER w <= 2 AND count(*) FILTER (role = 'assistant') OVER w <= 1""",
)
def b17(spark, sf):
    return p.turn_limits(table(spark, sf, "conversations"), 2, 1).select("conv_id", "turn", "role")


@query(
    "b18_length_limits",
    r"""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(string_split(text, chr(10))[1], '\s+'), lambda x: x <> '')) AS a, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS b FROM documents)
        SELECT doc_id FROM w WHERE a <= 10 AND b <= 300""",
)
def b18(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("prompt"), "text")
    return p.length_limits(docs, "prompt", "text", 10, 300).select("doc_id")


@query("b19_raw_chat", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id")
def b19(spark, sf):
    chats = p.raw_chat(table(spark, sf, "conversations"))
    return chats.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@query("b20_assign_batches", "SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 256)::BIGINT AS batch, ((row_number() OVER (ORDER BY ts, event_id) - 1) % 256)::INTEGER AS slot FROM events")
def b20(spark, sf):
    return p.assign_batches(table(spark, sf, "events").select("event_id", "ts"), 256, ["ts", "event_id"]).select("event_id", "batch", "slot")


@query("c1_render", "SELECT doc_id, 'Language: ' || lang || chr(10) || 'From ' || source || ' (' || doc_id || ')' AS prompt FROM documents")
def c1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.render("Language: {lang}\nFrom {source} ({doc_id})").alias("prompt"))


@query("c2_strip", r"SELECT doc_id, regexp_replace(' ' || chr(9) || text || chr(10) || ' ', '^\s+|\s+$', '', 'g') AS bare FROM documents")
def c2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.strip(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))).alias("bare"))


@query("c3_index", "SELECT doc_id, string_split(text, ' ')[3] AS word, string_split(text, ' ')[100000] AS far FROM documents")
def c3(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", t.index(words, 2).alias("word"), t.index(words, 99_999).alias("far"))


@query("c4_slice_text", "SELECT doc_id, substring(text, 1 + (doc_id % 7)::INTEGER, 9) AS part FROM documents")
def c4(spark, sf):
    start = (F.col("doc_id") % 7).cast("int")
    return table(spark, sf, "documents").select("doc_id", t.slice_text(F.col("text"), start, start + 9).alias("part"))


@query("c5_lettered_options", f"SELECT doc_id, array_to_string(list_transform([0, 1, 2, 3], lambda i: substring('ABCD', i + 1, 1) || '. ' || {QUARTER_SQL}), chr(10)) AS options FROM documents")
def c5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.lettered_options(F.array(*four_choices())).alias("options"))


@query("c6_first_defined", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN role END, text) AS prompt FROM conversations")
def c6(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("prompt", F.when(F.col("turn") % 2 == 0, F.col("role")))
    return turns.select("conv_id", "turn", t.first_defined(turns, "absent", "prompt", "text").alias("prompt"))


@query("c7_choice_sentences", "SELECT item_id, array_to_string(list_transform(['Yes', 'No'], lambda x: text || '? ' || x || ', ' || reverse(text)), '|') AS choices FROM benchmark")
def c7(spark, sf):
    made = t.choice_sentences(F.col("text"), ["? Yes, ", "? No, "], F.reverse("text"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(made, "|").alias("choices"))


@query("c8_join_contexts", "SELECT doc_id, array_to_string(string_split(text, '. '), chr(10)) AS context FROM documents")
def c8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.join_contexts(F.split("text", r"\. ")).alias("context"))


@query("c9_ensure_period", r"WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN x LIKE '%.' THEN x ELSE x || '.' END AS sentence FROM b")
def c9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.ensure_period(F.col("text")).alias("sentence"))


@query(
    "c10_squash_tokens",
    r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g'), '^ | $', '', 'g') AS code,
        regexp_replace(regexp_replace(replace(text, chr(10), ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS docstring FROM documents""",
)
def c10(spark, sf):
    tokens = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", t.squash_tokens(tokens).alias("code"), t.squash_tokens(tokens, "").alias("docstring"))


@query("c11_with_description", "SELECT item_id, 'Answer the question.' || chr(10) || text AS prompt FROM benchmark")
def c11(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", t.with_description("Answer the question.\n", F.col("text")).alias("prompt"))


@query("c12_with_target_delimiter", "SELECT item_id, text || ' ' || reverse(text) AS spaced, text || chr(10) || reverse(text) AS lined FROM benchmark")
def c12(spark, sf):
    a, b = F.col("text"), F.reverse("text")
    return table(spark, sf, "benchmark").select("item_id", t.with_target_delimiter(a, b).alias("spaced"), t.with_target_delimiter(a, b, "\n").alias("lined"))


@query("c13_prompt_variants", "SELECT item_id, v AS variant, CASE v WHEN 0 THEN 'Q: ' || text WHEN 1 THEN text || ' A:' ELSE text END AS prompt FROM benchmark, (SELECT unnest([0, 1, 2]) AS v)")
def c13(spark, sf):
    return t.prompt_variants(table(spark, sf, "benchmark").select("item_id", "text"), ["Q: {text}", "{text} A:", "{text}"]).drop("text")


ITEMS_SQL = f"items AS (SELECT lang AS task, doc_id, text AS prompt, {CHOICES_SQL} AS choices, reverse(text) AS target FROM documents)"


def mc_items(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", F.col("text").alias("prompt"), F.array(*four_choices()).alias("choices"), F.reverse("text").alias("target"))


@query("d1_mc_requests", f"WITH {ITEMS_SQL} SELECT task, doc_id, i AS idx, prompt AS context, ' ' || choices[i + 1] AS continuation, 'loglikelihood' AS output_type FROM items, (SELECT unnest([0, 1, 2, 3]) AS i)")
def d1(spark, sf):
    return r.mc_requests(mc_items(spark, sf))


@query("d2_generate_requests", f"WITH {ITEMS_SQL} SELECT task, doc_id, prompt AS context, chr(10) || '|</s>' AS until, 64 AS max_len, 'generate_until' AS output_type FROM items")
def d2(spark, sf):
    return r.generate_requests(mc_items(spark, sf), ["\n", "</s>"], 64).withColumn("until", F.array_join("until", "|"))


@query("d3_rolling_requests", "SELECT lang AS task, doc_id, '' AS context, text AS continuation, 'loglikelihood_rolling' AS output_type FROM documents")
def d3(spark, sf):
    return r.rolling_requests(table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", "text"))


@query("d4_repeat_requests", "SELECT item_id, r AS repeat FROM benchmark, (SELECT unnest([0, 1, 2]) AS r)")
def d4(spark, sf):
    return r.repeat_requests(table(spark, sf, "benchmark").select("item_id"), 3)


POOL_SQL = "pool AS (SELECT lang AS task, doc_id, text AS example, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents)"


def pool(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", F.col("text").alias("example"))


@query(
    "d5_fewshot_first_n",
    f"""WITH {ITEMS_SQL}, {POOL_SQL}, shots AS (SELECT task, string_agg(example, chr(10) || chr(10) ORDER BY doc_id) AS shots FROM pool WHERE place <= 3 GROUP BY task)
        SELECT task, doc_id, coalesce(shots || chr(10) || chr(10), '') || prompt AS prompt FROM items LEFT JOIN shots USING (task)""",
)
def d5(spark, sf):
    return r.fewshot_first_n(mc_items(spark, sf), pool(spark, sf), 3).select("task", "doc_id", "prompt")


@query(
    "d6_fewshot_exclude_self",
    f"""WITH {ITEMS_SQL}, {POOL_SQL}, shot AS (SELECT i.task, i.doc_id, p.doc_id AS other, p.example, row_number() OVER (PARTITION BY i.task, i.doc_id ORDER BY p.doc_id) AS k
          FROM items i JOIN pool p ON p.task = i.task AND p.place <= 3 AND p.doc_id <> i.doc_id)
        SELECT i.task, i.doc_id, coalesce((SELECT string_agg(example, chr(10) || chr(10) ORDER BY other) FROM shot s WHERE s.task = i.task AND s.doc_id = i.doc_id AND k <= 2) || chr(10) || chr(10), '') || prompt AS prompt FROM items i""",
)
def d6(spark, sf):
    return r.fewshot_exclude_self(mc_items(spark, sf), pool(spark, sf), 2).select("task", "doc_id", "prompt")


@query(
    "d7_num_fewshot",
    f"""WITH {ITEMS_SQL}, {POOL_SQL}, n AS (SELECT * FROM (VALUES ('en', 5), ('fr', 2), ('de', 0)) v(task, n)),
        shots AS (SELECT task, string_agg(example, chr(10) || chr(10) ORDER BY doc_id) AS shots FROM pool JOIN n USING (task) WHERE place <= n GROUP BY task)
        SELECT task, doc_id, coalesce(shots || chr(10) || chr(10), '') || prompt AS prompt FROM items LEFT JOIN shots USING (task)""",
)
def d7(spark, sf):
    return r.num_fewshot(mc_items(spark, sf), pool(spark, sf), {"en": 5, "fr": 2, "de": 0}).select("task", "doc_id", "prompt")


@query(
    "d8_request_fingerprint",
    f"""WITH {ITEMS_SQL}, req AS (SELECT task, sha256(concat_ws(chr(31), prompt, ' ' || choices[i + 1], 'loglikelihood')) AS h FROM items, (SELECT unnest([0, 1, 2, 3]) AS i)),
        part AS (SELECT task, count(*) AS n, sum(('0x' || substring(h, 1, 15))::BIGINT) AS a, sum(('0x' || substring(h, 16, 15))::BIGINT) AS b, sum(('0x' || substring(h, 31, 15))::BIGINT) AS c FROM req GROUP BY task)
        SELECT task, n AS requests, sha256(concat_ws(',', n, a, b, c)) AS fingerprint FROM part""",
)
def d8(spark, sf):
    return r.request_fingerprint(r.mc_requests(mc_items(spark, sf)))


@query("d9_target_requests", f"WITH {ITEMS_SQL} SELECT task, doc_id, prompt AS context, ' ' || target AS continuation, 'loglikelihood' AS output_type FROM items")
def d9(spark, sf):
    return r.target_requests(mc_items(spark, sf))


@query(
    "d8_equal_request_sets",
    f"""WITH {ITEMS_SQL}, twin AS (SELECT 'copy_' || task AS task, prompt, choices FROM items WHERE task <> 'fr' UNION ALL SELECT task, prompt, choices FROM items),
        req AS (SELECT task, sha256(concat_ws(chr(31), prompt, ' ' || choices[i + 1], 'loglikelihood')) AS h FROM twin, (SELECT unnest([0, 1, 2, 3]) AS i)),
        part AS (SELECT task, count(*) AS n, sum(('0x' || substring(h, 1, 15))::BIGINT) AS a, sum(('0x' || substring(h, 16, 15))::BIGINT) AS b, sum(('0x' || substring(h, 31, 15))::BIGINT) AS c FROM req GROUP BY task)
        SELECT sha256(concat_ws(',', n, a, b, c)) AS fingerprint, string_agg(task, ',' ORDER BY task) AS tasks FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def d8_equal(spark, sf):
    """Every task but French stands twice, under two names."""
    items = mc_items(spark, sf)
    twin = items.unionByName(items.where("task <> 'fr'").withColumn("task", F.concat(F.lit("copy_"), "task")))
    return r.equal_request_sets(r.request_fingerprint(r.mc_requests(twin))).select("fingerprint", F.array_join("tasks", ",").alias("tasks"))


@query(
    "d1_stored_requests",
    f"""WITH {ITEMS_SQL} SELECT task, doc_id, i AS idx, md5(prompt || ' ' || choices[i + 1]) AS request, (0 - (doc_id * 7919 + i * 104729) % 1000)::DOUBLE / 100.0 AS loglik FROM items, (SELECT unnest([0, 1, 2, 3]) AS i)""",
)
def d1_stored(spark, sf):
    """Requests stored with each prompt once, joined bucket by bucket with stand-in responses of model 0."""
    buckets = spark.sparkContext.defaultParallelism
    stored = r.store_mc_requests(mc_items(spark, sf), buckets)
    answers = r.store_responses(mc_responses(spark, sf).where("model = 0").select("task", "doc_id", "idx", (F.col("loglik") + 0.0).alias("loglik")), buckets)
    return stored.with_responses(spark, answers).select("task", "doc_id", "idx", F.md5(F.concat("context", "continuation")).alias("request"), "loglik")


VERSIONS_SQL = """req AS (SELECT task, doc_id, i AS idx, prompt, ' ' || choices[i + 1] AS c FROM items, (SELECT unnest([0, 1, 2, 3]) AS i)),
        newer AS (SELECT task, doc_id, idx, CASE WHEN doc_id % 50 = 7 AND idx = 2 THEN prompt || '!' ELSE prompt END AS prompt, c FROM req WHERE doc_id % 97 <> 5)"""


def newer(requests):
    """A second version: some prompts changed, some items gone."""
    changed = F.when((F.col("doc_id") % 50 == 7) & (F.col("idx") == 2), F.concat("context", F.lit("!"))).otherwise(F.col("context"))
    return requests.where(F.col("doc_id") % 97 != 5).withColumn("context", changed)


@query(
    "d8_request_tree",
    f"""WITH {ITEMS_SQL}, req AS (SELECT task, sha256(concat_ws(chr(31), prompt, ' ' || choices[i + 1], 'loglikelihood')) AS h FROM items, (SELECT unnest([0, 1, 2, 3]) AS i)),
        held AS (SELECT task, h, count(*) AS n FROM req GROUP BY ALL), nodes AS (SELECT task, left(h, 2) AS node, sum(n)::BIGINT AS requests, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS hash FROM held GROUP BY ALL)
        FROM nodes UNION ALL SELECT task, '', sum(requests)::BIGINT, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) FROM nodes GROUP BY task""",
)
def d8_tree(spark, sf):
    return r.request_tree(r.mc_requests(mc_items(spark, sf)), digits=2)


@query(
    "d8_request_changes",
    f"""WITH {ITEMS_SQL}, {VERSIONS_SQL}, o AS (SELECT task, doc_id, idx, prompt, c, count(*) AS n FROM req GROUP BY ALL), w AS (SELECT task, doc_id, idx, prompt, c, count(*) AS n FROM newer GROUP BY ALL)
        SELECT task, doc_id, idx, CASE WHEN coalesce(w.n, 0) < coalesce(o.n, 0) THEN 'removed' ELSE 'added' END AS change, abs(coalesce(w.n, 0) - coalesce(o.n, 0)) AS copies
        FROM o FULL JOIN w USING (task, doc_id, idx, prompt, c) WHERE coalesce(w.n, 0) <> coalesce(o.n, 0)""",
)
def d8_changes(spark, sf):
    requests = r.mc_requests(mc_items(spark, sf))
    return r.request_changes(requests, newer(requests))
