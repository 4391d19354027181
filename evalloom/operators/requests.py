"""Scoring requests and few-shot prompts from prepared items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.plans.staging import fresh_path, staged


def mc_requests(items: DataFrame, delimiter: str = " ") -> DataFrame:
    """One log-likelihood request for each choice of (task, doc_id, prompt, choices)."""
    rows = items.select("task", "doc_id", F.col("prompt").alias("context"), F.posexplode("choices").alias("idx", "choice"))
    return rows.select("task", "doc_id", "idx", "context", F.concat(F.lit(delimiter), "choice").alias("continuation"), F.lit("loglikelihood").alias("output_type"))


@dataclass(frozen=True)
class StoredRequests:
    """Tables of multiple-choice requests, bucketed alike on (task, doc_id): each prompt stands once, and its choices refer to it."""

    contexts: str  #: task, doc_id, context
    choices: str  #: task, doc_id, idx, continuation
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        """The requests as ``mc_requests`` gives them; the tables meet bucket by bucket, without a shuffle."""
        rows = spark.table(self.choices).join(spark.table(self.contexts), ["task", "doc_id"])
        return rows.select("task", "doc_id", "idx", "context", "continuation", F.lit("loglikelihood").alias("output_type"))

    def with_responses(self, spark: SparkSession, responses: str) -> DataFrame:
        """The requests that a table of ``store_responses`` has answers to, with the answers' columns; no shuffle either."""
        rows = self.read(spark).join(spark.table(responses), ["task", "doc_id"])
        answered = rows.withColumn("_answer", F.explode(F.filter("answers", lambda a: a["idx"] == F.col("idx")))).drop("answers")
        fields = [n for n in answered.schema["_answer"].dataType.names if n != "idx"]
        return answered.select(*[c for c in answered.columns if c != "_answer"], *[F.col("_answer")[n].alias(n) for n in fields])


def store_bucketed(rows: DataFrame, name: str, buckets: int, keys: Sequence[str] = ("task", "doc_id")) -> str:
    """Writes rows into the shared folder as a table bucketed on ``keys`` and sorted in its buckets, one file each, and returns the table's name."""
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *keys)
    dealt.write.option("path", fresh_path(rows.sparkSession, name)).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return table


def store_responses(responses: DataFrame, buckets: int) -> str:
    """Stores (task, doc_id, idx, further columns) with a row for each item and its answers as an array, bucketed as the requests are."""
    answers = F.struct("idx", *[c for c in responses.columns if c not in ("task", "doc_id", "idx")])
    return store_bucketed(responses.groupBy("task", "doc_id").agg(F.collect_list(answers).alias("answers")), "responses", buckets)


def store_mc_requests(items: DataFrame, buckets: int, delimiter: str = " ") -> StoredRequests:
    """Stores (task, doc_id, prompt, choices) so that scoring jobs read each prompt once and never shuffle it again.

    Responses written with ``store_responses`` and as many buckets join without a shuffle too. A frequent task spreads over all buckets because doc_id is
    part of the key. Task and doc_id must not be null, and name one item.
    """
    contexts = items.select("task", "doc_id", F.col("prompt").alias("context"))
    choices = items.select("task", "doc_id", F.posexplode("choices").alias("idx", "choice")).select("task", "doc_id", "idx", F.concat(F.lit(delimiter), "choice").alias("continuation"))
    return StoredRequests(store_bucketed(contexts, "contexts", buckets), store_bucketed(choices, "choices", buckets), buckets)


def generate_requests(items: DataFrame, until: Sequence[str], max_len: int) -> DataFrame:
    stops = F.array(*[F.lit(u) for u in until]).cast("array<string>")
    return items.select("task", "doc_id", F.col("prompt").alias("context"), stops.alias("until"), F.lit(max_len).alias("max_len"), F.lit("generate_until").alias("output_type"))


def rolling_requests(docs: DataFrame) -> DataFrame:
    """The whole text after an empty context."""
    return docs.select("task", "doc_id", F.lit("").alias("context"), F.col("text").alias("continuation"), F.lit("loglikelihood_rolling").alias("output_type"))


def repeat_requests(requests: DataFrame, n: int) -> DataFrame:
    return requests.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def target_requests(items: DataFrame, delimiter: str = " ") -> DataFrame:
    return items.select("task", "doc_id", F.col("prompt").alias("context"), F.concat(F.lit(delimiter), "target").alias("continuation"), F.lit("loglikelihood").alias("output_type"))


def smallest(rows: DataFrame, group: str, order: str, most: int | Mapping[object, int]) -> DataFrame:
    """group and order of the rows with the smallest ``order`` in each group, ``most`` of them (or a number for each group; none for the others).

    Tasks keep no more than that many rows of a group while they read, whatever the number is, and pass on only these; nulls are smallest. Of
    equal rows as many stay as fit.
    """
    wanted = dict(most) if isinstance(most, Mapping) else None

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.take(pc.sort_indices(table, sort_keys=[("g", "ascending"), ("o", "ascending")], null_placement="at_start"))
            code = table.column("g").combine_chunks().dictionary_encode(null_encoding="encode")
            groups, own = code.dictionary.to_pylist(), code.indices.to_numpy()
            bounds = np.array([most if wanted is None else wanted.get(g, 0) for g in groups], np.int64)
            begins = np.searchsorted(own, np.arange(len(groups)))  # sorted by group, so codes ascend
            held = table.take(pa.array(np.flatnonzero(np.arange(len(own)) - begins[own] < bounds[own])))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    narrow = rows.select(F.col(group).alias("g"), F.col(order).alias("o"))
    kept = narrow.mapInArrow(bound, narrow.schema)
    limit = F.lit(most) if wanted is None else F.coalesce(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("g")] if wanted else F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.col("o").asc_nulls_first()))
    return kept.withColumn("_place", place).where(F.col("_place") <= limit).select(F.col("g").alias(group), F.col("o").alias(order))


#: Parts of a task's items that read its shots apart where shots are too large to broadcast.
SALTS = 64


def _first(pool: DataFrame, most: int | Mapping[object, int], max_broadcast: int = 100_000) -> DataFrame:
    """task and shots: the first rows of each task's pool as an ordered array (doc_id, example).

    Identifiers decide first; texts are read for the winners alone, which are broadcast while there are at most ``max_broadcast``.
    """
    winners = staged(smallest(pool, "task", "doc_id", most).groupBy("task", "doc_id").agg(F.count("*").cast("int").alias("_n")), "shots").withColumnsRenamed({"task": "_t", "doc_id": "_d"})
    side = F.broadcast(winners) if winners.limit(max_broadcast + 1).count() <= max_broadcast else winners
    near = pool.join(side, F.col("task").eqNullSafe(F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    order = Window.partitionBy("task", "doc_id").orderBy("example")  # of repeated identifiers as many as won
    held = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n"))
    return held.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("doc_id", "example"))).alias("shots"))


def _before(items: DataFrame, shots: DataFrame, taken: Column, separator: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Puts the examples in front of each prompt; the pool is one row a task by now.

    Shots of ``max_bytes`` at most are broadcast, so no item moves. Of more, a task's shots are read by ``SALTS`` parts of its items, so
    that no task of the cluster reads all items of a frequent one.
    """
    shots = staged(shots, "task-shots")
    size = shots.agg(F.sum(F.octet_length("task") + F.aggregate("shots", F.lit(0).cast("long"), lambda n, s: n + 32 + F.coalesce(F.octet_length(s["example"].cast("string")), F.lit(0))))).first()[0]
    if (size or 0) <= max_bytes:
        joined = items.join(F.broadcast(shots), "task", "left")
    else:
        parts = shots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parts, ["task", "_salt"], "left").drop("_salt")
    text = F.array_join(F.transform(taken, lambda s: s["example"]), separator)
    return joined.withColumn("prompt", F.when(F.size(taken) > 0, F.concat(text, F.lit(separator), "prompt")).otherwise(F.col("prompt"))).drop("shots")


def fewshot_first_n(items: DataFrame, pool: DataFrame, n: int, separator: str = "\n\n") -> DataFrame:
    """The first ``n`` examples of the task's pool (task, doc_id, example), in order, before each prompt."""
    return _before(items, _first(pool, n), F.col("shots"), separator)


def fewshot_exclude_self(items: DataFrame, pool: DataFrame, n: int, separator: str = "\n\n") -> DataFrame:
    """As ``fewshot_first_n``, but an item is never its own example: n + 1 are held, and the item's own is left out."""
    others = F.slice(F.filter("shots", lambda s: s["doc_id"] != F.col("doc_id")), 1, n)
    return _before(items, _first(pool, n + 1), others, separator)


def num_fewshot(items: DataFrame, pool: DataFrame, counts: Mapping[str, int], separator: str = "\n\n") -> DataFrame:
    """As ``fewshot_first_n`` with a number for each task; tasks without one get no examples."""
    return _before(items, _first(pool, counts), F.col("shots"), separator)


FIELDS = ("context", "continuation", "output_type")


def request_hash(fields: Sequence[str] = FIELDS) -> Column:
    """SHA-256 of one request."""
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def _added(hashed: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, requests, fingerprint: hashes cut into three numbers of 60 bits, which are summed; sums combine before the shuffle."""
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = hashed.groupBy(*by).agg(F.count("*").alias("requests"), *[part(i).alias(f"s{i}") for i in range(3)])
    return sums.select(*by, "requests", F.sha2(F.concat_ws(",", F.col("requests").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(3)]), 256).alias("fingerprint"))


def request_fingerprint(requests: DataFrame, fields: Sequence[str] = FIELDS, by: str = "task") -> DataFrame:
    """task, requests (their number), fingerprint: SHA-256 of a task's requests as a set with repeats, in any order.

    Each request's own SHA-256 is cut into three numbers of 60 bits, and these are summed; no
    task gathers all of its hashes anywhere. Tasks with equal requests have equal fingerprints. Where someone may choose requests so that sums
    collide, or places of difference are asked for, ``request_tree`` is the stronger form.
    """
    return _added(requests.select(by, request_hash(fields).alias("h")), [by])


def request_tree(requests: DataFrame, digits: int = 3, fields: Sequence[str] = FIELDS, by: str = "task", most: int = 100_000) -> DataFrame:
    """task, node, requests, hash: two levels of hashes over a task's requests, the root (node '') and a node for each prefix of ``digits`` hex digits.

    A node's hash is the SHA-256 of its requests' hashes in order (repeats included), the root's that of its nodes' names and hashes. A request
    can change only its own node, so equal nodes need not be looked at again. A node's different hashes and their numbers are gathered in one
    task, about one in 16**digits of its task's; choose ``digits`` so that these are at most ``most`` (an error otherwise).
    """
    hashed = requests.select(by, request_hash(fields).alias("h")).groupBy(by, "h").agg(F.count("*").alias("n"))  # repeats are one row
    listed = F.transform(F.sort_array(F.collect_list(F.struct("h", "n"))), lambda x: F.concat_ws(":", x["h"], x["n"].cast("string")))
    nodes = hashed.groupBy(by, F.substring("h", 1, digits).alias("node")).agg(F.sum("n").alias("requests"), F.sha2(F.array_join(listed, ","), 256).alias("hash"), F.count("*").alias("held"))
    checked = F.when(F.col("held") > most, F.raise_error(F.concat(F.lit("a node of too many requests; use more digits: "), F.col("held").cast("string")))).otherwise(F.col("hash"))
    nodes = staged(nodes.select(by, "node", "requests", checked.alias("hash")), "request-nodes")
    named = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"], x["hash"]))
    roots = nodes.groupBy(by).agg(F.lit("").alias("node"), F.sum("requests").alias("requests"), F.sha2(F.array_join(named, ","), 256).alias("hash"))  # at most 16**digits nodes
    return nodes.unionByName(roots)


def request_changes(old: DataFrame, new: DataFrame, digits: int = 3, fields: Sequence[str] = FIELDS, by: str = "task", keys: Sequence[str] = ("doc_id", "idx"), max_broadcast: int = 1_000_000) -> DataFrame:
    """task, keys, change (removed or added), copies: requests that stand more often in one version than in the other.

    The versions' trees are compared first; requests are only shuffled where their tasks' roots and their own nodes differ.
    """
    trees = [request_tree(side, digits, fields, by) for side in (old, new)]
    left, right = (t.where("node <> ''").select(F.col(by).alias("_t"), F.col("node").alias("_node"), F.col("hash").alias(f"_h{i}")) for i, t in enumerate(trees))
    unequal = staged(left.join(right, ["_t", "_node"], "full").where(~F.col("_h0").eqNullSafe(F.col("_h1"))).select("_t", "_node"), "unequal-nodes")
    side = F.broadcast(unequal) if unequal.count() <= max_broadcast else unequal

    def there(rows: DataFrame, sign: int) -> DataFrame:
        hashed = rows.select(F.col(by).alias("_t"), *keys, request_hash(fields).alias("_h")).withColumn("_node", F.substring("_h", 1, digits))
        return hashed.join(side, ["_t", "_node"], "left_semi").groupBy("_t", *keys, "_h").agg(F.count("*").alias("_n")).withColumn("_n", F.col("_n") * sign)

    sums = there(old, -1).unionByName(there(new, 1)).groupBy("_t", *keys, "_h").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return sums.select(F.col("_t").alias(by), *keys, F.when(F.col("_n") < 0, "removed").otherwise("added").alias("change"), F.abs("_n").alias("copies"))


def equal_request_sets(fingerprints: DataFrame) -> DataFrame:
    """fingerprint and tasks for every fingerprint that several tasks share."""
    return fingerprints.groupBy("fingerprint").agg(F.sort_array(F.collect_set("task")).alias("tasks")).where(F.size("tasks") > 1)
