"""Queries over generated texts: filters, scores, corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import postfilter as e
from evalloom.operators import scores
from evalloom.operators import text_metrics as x
from evalloom.plans.staging import spread
from evalloom.queries.registry import GEN_SQL, generations, query, round6, table

BAG = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
#: Common tokens with multiplicity of two token lists, given as a set of (key, side, token).
COMMON_SQL = """tok AS (SELECT doc_id, 0 AS side, unnest(a) AS w FROM two UNION ALL SELECT doc_id, 1, unnest(b) FROM two),
  cnt AS (SELECT doc_id, w, sum(1 - side) AS na, sum(side) AS nb FROM tok GROUP BY ALL),
  com AS (SELECT doc_id, sum(least(na, nb)) AS common FROM cnt GROUP BY doc_id)"""
F1_SQL = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * common / (len(a) + len(b)) END"


def pair_sql(tokens: str, name: str) -> str:
    """F1 of common tokens of each text and its item. Items are cut into tokens once each, and no part is worked out twice."""
    return f"""WITH a AS MATERIALIZED (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {tokens} AS a FROM documents),
      b AS MATERIALIZED (SELECT item_id, {tokens} AS b FROM benchmark),
      ca AS (SELECT doc_id, item_id, w, count(*) AS n FROM (SELECT doc_id, item_id, unnest(a) AS w FROM a) GROUP BY ALL),
      cb AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(b) AS w FROM b) GROUP BY ALL),
      com AS (SELECT doc_id, sum(least(ca.n, cb.n)) AS common FROM ca JOIN cb USING (item_id, w) GROUP BY doc_id)
      SELECT doc_id, round({F1_SQL}, 6) AS {name} FROM a JOIN b USING (item_id) LEFT JOIN com USING (doc_id)"""


@query("e1_stop_at", "SELECT doc_id, string_split(string_split(text, chr(10))[1], '. ')[1] AS cut FROM documents")
def e1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", e.stop_at(F.col("text"), ["\n", ". "]).alias("cut"))


@query("e2_strict_match", r"SELECT doc_id, nullif(regexp_extract(replace(text, 'The ', 'the answer is (T) or ') || ' so the answer is (' || upper(right(text, 1)) || '), or the answer is (' || substring(text, 1, 1) || ')', 'answer is \(([A-M])\)', 1), '') AS answer FROM documents")
def e2(spark, sf):
    """Whole texts, in which answers outside the pattern's letters stand before the one that is looked for."""
    told = F.replace("text", F.lit("The "), F.lit("the answer is (T) or "))
    text = F.concat(told, F.lit(" so the answer is ("), F.upper(F.substring("text", -1, 1)), F.lit("), or the answer is ("), F.substring("text", 1, 1), F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", e.strict_match(text, r"answer is \(([A-M])\)").alias("answer"))


@query("e3_extract_choice_letter", r"SELECT doc_id, nullif(regexp_extract('Well. ANSWER: ' || upper(substring(text, 1, 1)) || '. ' || text, '(?i:answer)\s*:?\s*\(?([ABCD])\b', 1), '') AS letter FROM documents")
def e3(spark, sf):
    text = F.concat(F.lit("Well. ANSWER: "), F.upper(F.substring("text", 1, 1)), F.lit(". "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", e.extract_choice_letter(text).alias("letter"))


@query("e4_take_first", "SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY ALL")
def e4(spark, sf):
    return e.take_first(table(spark, sf, "conversations").withColumn("repeat", F.col("turn")), ["conv_id", "role"])


@query("e5_normalize_answer", f"SELECT doc_id, {NORM.format('text')} AS answer FROM documents")
def e5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", e.normalize_answer(F.col("text")).alias("answer"))


@query(
    "f4_exact_match",
    r"""WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'a', 'A') ELSE replace(text, '.', '!') END AS target FROM documents)
        SELECT doc_id, (text = target)::INTEGER::DOUBLE AS strict, (lower(text) = lower(target))::INTEGER::DOUBLE AS any_case,
        (regexp_replace(text, '[\p{P}\p{S}]', '', 'g') = regexp_replace(target, '[\p{P}\p{S}]', '', 'g'))::INTEGER::DOUBLE AS bare FROM t""",
)
def f4(spark, sf):
    text = F.col("text")
    target = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.replace(text, F.lit("a"), F.lit("A"))).otherwise(F.replace(text, F.lit("."), F.lit("!")))
    forms = {"strict": {}, "any_case": {"ignore_case": True}, "bare": {"ignore_punctuation": True}}
    return table(spark, sf, "documents").select("doc_id", *[scores.exact_match(text, target, **options).alias(name) for name, options in forms.items()])


@query("f5_token_f1", pair_sql(BAG.format(NORM.format("text")), "f1"))
def f5(spark, sf):
    return generations(spark, sf).select("doc_id", round6(scores.token_f1(e.normalize_answer(F.col("pred")), e.normalize_answer(F.col("ref")))).alias("f1"))


@query(
    "f5_token_f1_any",
    f"""WITH {GEN_SQL}, both AS (SELECT doc_id * 2 AS doc_id, pred, ref FROM gen UNION ALL SELECT doc_id * 2 + 1, pred, replace(pred, ' the ', ' a ') FROM gen), two AS (SELECT doc_id, {BAG.format('pred')} AS a, {BAG.format('ref')} AS b FROM both), {COMMON_SQL}
        SELECT doc_id // 2 AS doc_id, round(max({F1_SQL}), 6) AS f1 FROM two LEFT JOIN com USING (doc_id) GROUP BY 1""".replace("both AS", "sides AS").replace("FROM both", "FROM sides"),
)
def f5_any(spark, sf):
    return generations(spark, sf).select("doc_id", round6(scores.token_f1_any(F.col("pred"), F.array("ref", F.replace("pred", F.lit(" the "), F.lit(" a "))))).alias("f1"))



@query("f7_contains", f"WITH r AS (SELECT doc_id, lower(text) AS pred, list_transform([substring(text, 10, 6), substring(text, 500, 6), 'THE '], lambda x: lower(x)) AS refs FROM documents) SELECT doc_id, (len(list_filter(refs, lambda x: contains(pred, x))) > 0)::INTEGER::DOUBLE AS any_ref, round(len(list_filter(refs, lambda x: contains(pred, x)))::DOUBLE / 3, 6) AS fraction FROM r")
def f7(spark, sf):
    refs = F.array(F.substring("text", 10, 6), F.substring("text", 500, 6), F.lit("THE "))
    pred = F.col("text")
    return table(spark, sf, "documents").select("doc_id", scores.contains_any(pred, refs).alias("any_ref"), round6(scores.contains_fraction(pred, refs)).alias("fraction"))


@query("f8_rouge1", pair_sql(r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')", "rouge1"))
def f8(spark, sf):
    return generations(spark, sf).select("doc_id", round6(scores.rouge1(F.col("pred"), F.col("ref"))).alias("rouge1"))


@query(
    "f8_rouge1_any",
    r"""WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, unnest([replace(text, ' the ', ' a '), replace(replace(text, 'e', 'i'), ' of ', ' ')]) AS ref, unnest([0, 1]) AS k FROM documents),
      two AS MATERIALIZED (SELECT doc_id, k, a, regexp_extract_all(lower(ref), '[\p{L}\p{N}]+') AS b FROM t),
      tok AS (SELECT doc_id, k, 0 AS side, unnest(a) AS w FROM two UNION ALL SELECT doc_id, k, 1, unnest(b) FROM two),
      cnt AS (SELECT doc_id, k, w, sum(1 - side) AS na, sum(side) AS nb FROM tok GROUP BY ALL), com AS (SELECT doc_id, k, sum(least(na, nb)) AS common FROM cnt GROUP BY ALL)
      SELECT doc_id, round(max("""
    + F1_SQL
    + """), 6) AS rouge1 FROM two LEFT JOIN com USING (doc_id, k) GROUP BY doc_id""",
)
def f8_any(spark, sf):
    """Two references for each text."""
    refs = F.array(F.replace("text", F.lit(" the "), F.lit(" a ")), F.replace(F.replace("text", F.lit("e"), F.lit("i")), F.lit(" of "), F.lit(" ")))
    return spread(table(spark, sf, "documents")).select("doc_id", round6(scores.rouge1_any(F.col("text"), refs)).alias("rouge1"))


def altered(text):
    """A text with words changed and left out, as a reference."""
    return F.replace(F.replace(text, F.lit(" the "), F.lit(" a ")), F.lit(" of "), F.lit(" "))


def bleu_rows(spark, sf):
    """Whole texts against altered ones."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.col("lang").alias("task"), F.col("text").alias("pred"), altered(F.col("text")).alias("ref"))


def line_rows(spark, sf):
    """Every line of every text against an altered one: translation edits are counted sentence by sentence."""
    lines = spread(table(spark, sf, "documents")).select(F.col("lang").alias("task"), F.explode(F.split("text", "\n")).alias("pred"))
    return lines.withColumn("ref", altered(F.col("pred")))


BLEU_SQL = f"""gen AS (SELECT doc_id, lang AS task, {BAG.format('text')} AS p, {BAG.format("replace(replace(text, ' the ', ' a '), ' of ', ' ')")} AS r FROM documents),
  tk AS (SELECT doc_id, 0 AS side, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM gen UNION ALL SELECT doc_id, 1, unnest(r), generate_subscripts(r, 1) FROM gen),
  ld AS (SELECT doc_id, side, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM tk WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
  g AS (SELECT doc_id, side, 1 AS n, w FROM ld UNION ALL SELECT doc_id, side, 2, w || chr(2) || w2 FROM ld WHERE w2 IS NOT NULL
        UNION ALL SELECT doc_id, side, 3, w || chr(2) || w2 || chr(2) || w3 FROM ld WHERE w3 IS NOT NULL UNION ALL SELECT doc_id, side, 4, w || chr(2) || w2 || chr(2) || w3 || chr(2) || w4 FROM ld WHERE w4 IS NOT NULL),
  c AS (SELECT doc_id, n, w, sum(1 - side) AS a, sum(side) AS b FROM g GROUP BY ALL),
  m AS (SELECT doc_id, n, sum(least(a, b)) AS hit FROM c GROUP BY ALL),
  s AS (SELECT task, gen.doc_id, n.n, coalesce(hit, 0) AS hit, greatest(len(p) - n.n + 1, 0) AS total, len(p) AS pl, len(r) AS rl FROM gen JOIN (SELECT unnest([1, 2, 3, 4]) AS n) n ON true LEFT JOIN m ON m.doc_id = gen.doc_id AND m.n = n.n)"""


@query("g8_bleu", f"WITH {BLEU_SQL}, t AS (SELECT task, n, sum(hit) AS hit, sum(total) AS total, sum(pl) AS pl, sum(rl) AS rl FROM s GROUP BY ALL) SELECT task, round(CASE WHEN min(hit) = 0 THEN 0.0 ELSE exp(sum(ln(greatest(hit, 1)::DOUBLE / total)) / 4 + least(0.0, 1 - max(rl)::DOUBLE / max(pl))) END, 6) AS bleu FROM t GROUP BY task")
def g8(spark, sf):
    return x.bleu(bleu_rows(spark, sf), "pred", "ref", ["task"]).withColumn("bleu", round6(F.col("bleu")))


@query("g3_bootstrap_bleu")
def g3_bleu(spark, sf):
    return x.bootstrap_bleu(bleu_rows(spark, sf), "pred", "ref", ["task"], replicates=1000)


#: n-grams of a text (side 0) and of two references, with the most that one reference has.
REFS_SQL = f"""gen AS (SELECT doc_id, lang AS task, {BAG.format('text')} AS p, {BAG.format("replace(replace(text, ' the ', ' a '), ' of ', ' ')")} AS r, {BAG.format("replace(text, 'e ', 'a ')")} AS q FROM documents),
  tk AS (SELECT doc_id, 0 AS side, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM gen UNION ALL SELECT doc_id, 1, unnest(r), generate_subscripts(r, 1) FROM gen UNION ALL SELECT doc_id, 2, unnest(q), generate_subscripts(q, 1) FROM gen),
  ld AS (SELECT doc_id, side, w, lead(w, 1) OVER o AS w2 FROM tk WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
  g AS (SELECT doc_id, side, 1 AS n, w FROM ld UNION ALL SELECT doc_id, side, 2, w || chr(2) || w2 FROM ld WHERE w2 IS NOT NULL),
  c AS (SELECT doc_id, n, w, count(*) FILTER (side = 0) AS a, greatest(count(*) FILTER (side = 1), count(*) FILTER (side = 2)) AS b FROM g GROUP BY ALL),
  m AS (SELECT doc_id, n, sum(least(a, b)) AS hit FROM c GROUP BY ALL),
  s AS (SELECT task, gen.doc_id, n.n, coalesce(hit, 0) AS hit, greatest(len(p) - n.n + 1, 0) AS total, len(p) AS pl,
          CASE WHEN abs(len(r) - len(p)) < abs(len(q) - len(p)) THEN len(r) WHEN abs(len(r) - len(p)) > abs(len(q) - len(p)) THEN len(q) ELSE least(len(r), len(q)) END AS rl
        FROM gen JOIN (SELECT unnest([1, 2]) AS n) n ON true LEFT JOIN m ON m.doc_id = gen.doc_id AND m.n = n.n)"""


@query("g8_bleu_references", f"WITH {REFS_SQL}, t AS (SELECT task, n, sum(hit) AS hit, sum(total) AS total, sum(pl) AS pl, sum(rl) AS rl FROM s GROUP BY ALL) SELECT task, round(CASE WHEN min(hit) = 0 THEN 0.0 ELSE exp(sum(ln(greatest(hit, 1)::DOUBLE / total)) / 2 + least(0.0, 1 - max(rl)::DOUBLE / max(pl))) END, 6) AS bleu FROM t GROUP BY task")
def g8_references(spark, sf):
    """Two references for each text."""
    docs = spread(table(spark, sf, "documents"))
    rows = docs.select(F.col("lang").alias("task"), F.col("text").alias("pred"), F.array(altered(F.col("text")), F.replace("text", F.lit("e "), F.lit("a "))).alias("ref"))
    return x.bleu(rows, "pred", "ref", ["task"], order=2).withColumn("bleu", round6(F.col("bleu")))


@query("g9_smoothed_bleu_4", f"WITH {BLEU_SQL}, d AS (SELECT task, doc_id, CASE WHEN max(pl) = 0 OR min(hit) FILTER (n = 1) = 0 THEN 0.0 ELSE exp(sum(ln(greatest((hit + (n > 1)::INTEGER), 1)::DOUBLE / (total + (n > 1)::INTEGER))) / 4 + least(0.0, 1 - max(rl)::DOUBLE / max(pl))) END AS v FROM s GROUP BY ALL) SELECT task, round(avg(v), 6) AS bleu FROM d GROUP BY task")
def g9(spark, sf):
    return x.smoothed_bleu_4(bleu_rows(spark, sf), "pred", "ref", ["task"]).withColumn("bleu", round6(F.col("bleu")))


#: Characters of both texts, n-grams of 1 to 6 of them, and F2 of mean precision and recall.
CHRF_SQL = r"""WITH t AS MATERIALIZED (SELECT doc_id, lang AS task, string_split(regexp_replace(text, '\s', '', 'g'), '') AS p, string_split(regexp_replace(replace(replace(text, ' the ', ' a '), ' of ', ' '), '\s', '', 'g'), '') AS r FROM documents),
  c AS (SELECT doc_id, 0 AS side, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM t UNION ALL SELECT doc_id, 1, unnest(r), generate_subscripts(r, 1) FROM t),
  l AS MATERIALIZED (SELECT doc_id, side, w, w || lead(w, 1) OVER o AS w2, w || lead(w, 1) OVER o || lead(w, 2) OVER o AS w3, w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o AS w4,
      w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o || lead(w, 4) OVER o AS w5, w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o || lead(w, 4) OVER o || lead(w, 5) OVER o AS w6 FROM c WHERE w <> '' WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
  g AS (SELECT doc_id, side, 1 AS n, w FROM l UNION ALL SELECT doc_id, side, 2, w2 FROM l UNION ALL SELECT doc_id, side, 3, w3 FROM l UNION ALL SELECT doc_id, side, 4, w4 FROM l UNION ALL SELECT doc_id, side, 5, w5 FROM l UNION ALL SELECT doc_id, side, 6, w6 FROM l),
  k AS (SELECT doc_id, n, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g WHERE w IS NOT NULL GROUP BY ALL),
  m AS (SELECT task, n, sum(least(a, b))::DOUBLE AS hit, sum(a)::DOUBLE AS p, sum(b)::DOUBLE AS r FROM k JOIN t USING (doc_id) GROUP BY ALL),
  f AS (SELECT task, avg(hit / p) AS pr, avg(hit / r) AS re FROM m WHERE p > 0 AND r > 0 GROUP BY task)
SELECT task, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 5 * pr * re / (4 * pr + re) END, 6) AS chrf FROM f"""


@query("g10_chrf", CHRF_SQL)
def g10(spark, sf):
    return x.chrf(bleu_rows(spark, sf), "pred", "ref", ["task"]).withColumn("chrf", round6(F.col("chrf")))


@query("g11_ter")
def g11(spark, sf):
    return x.ter(line_rows(spark, sf), "pred", "ref", ["task"]).withColumn("ter", round6(F.col("ter")))
