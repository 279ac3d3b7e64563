"""The engine's registered queries over the driver's tables, and the same in SQL.

The tables hold no questions, so relational operators run on stand-ins: line items are scored rollouts of an order, orders
are votes of a customer, events are daily scores of a user, customers are problems in a region by segment grid. Rules on
texts of questions run on the authored cases of plans/cases.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import ids
from sievemill.functions import text as T
from sievemill.functions.vocab import BAND, CONTAINMENT, NEAR, SHARED
from sievemill.operators import audit, gates, grid, groups, labeling, novelty, pairing, replay, scoring, selection, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY = 14
OFFSET = 2
CHOSEN = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# --- the grid ---------------------------------------------------------------------------------------------------------

GRID_SQL = """
WITH cells AS (SELECT r_name || '/' || s AS cell FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer)),
p AS (SELECT c_custkey AS problem_id, c_nationkey AS created, r_name || '/' || c_mktsegment AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT problem_id, rq FROM (SELECT o_custkey AS problem_id, o_totalprice AS rq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) k FROM orders) WHERE k = 1),
j AS (SELECT p.*, coalesce(rq, -1.0) AS rq FROM p LEFT JOIN l USING (problem_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rq DESC, created, problem_id DESC) k, count(*) OVER (PARTITION BY cell) n FROM j)
SELECT cells.cell, coalesce(b.n, 0) AS n, b.problem_id AS representative FROM cells LEFT JOIN b ON cells.cell = b.cell AND k = 1
"""


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")
    customers = read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select(F.col("c_custkey").alias("problem_id"), F.col("c_nationkey").alias("created"), F.concat_ws("/", "r_name", "c_mktsegment").alias("cell"))


@query(GRID_SQL)
def map_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "region").select("r_name").join(read(spark, sf_dir, "customer").select("c_mktsegment").distinct()).select(F.concat_ws("/", "r_name", "c_mktsegment").alias("cell"))
    scores = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem_id"), F.col("o_orderdate").alias("iteration"), F.col("o_orderkey").alias("policy_version"), F.col("o_totalprice").alias("rq"))
    return grid.map_index(_problems(spark, sf_dir), grid.latest_scores(scores), cells, "cell", "problem_id", "created", "rq")


@query("SELECT r_name || '/' || c_mktsegment AS cell, count(*) AS n, min(c_custkey) AS first_id, max(c_custkey) AS last_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.min("problem_id").alias("first_id"), F.max("problem_id").alias("last_id"))


@query("SELECT DISTINCT o_custkey AS problem_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def unknown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("problem_id"))
    return tables.missing(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem_id")).distinct(), known, "problem_id")


# --- ids and texts ----------------------------------------------------------------------------------------------------

NORMAL = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"SELECT sha256(t) AS text_sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, {NORMAL} AS t FROM documents) GROUP BY 1 HAVING count(*) > 1")
def canonical_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(ids.normalized(F.col("text")), 256).alias("text_sha"))
    return docs.groupBy("text_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query(f"SELECT doc_id, 'problem_' || substr(sha256(CAST(to_json([{NORMAL}]) AS VARCHAR)), 1, 20) AS problem_id FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.problem_id(F.col("text")).alias("problem_id"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256('[42,\"wave\",' || doc_id || ',7]'), 9, 8)) AS BIGINT) & 2147483647 AS seed FROM documents")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.derived_seed(F.lit(42), "wave", F.col("doc_id"), F.lit(7)).alias("seed"))


TOKENS = r"regexp_extract_all(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[A-Za-z]+|\p{Nd}+|[^\p{L}\p{N}_\s]')"
SHINGLED = f"""
tok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
sh AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM tok)
"""


def _shingled(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    docs = read(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism).select(key, ids.normalized(F.col("text")).alias("text"))
    return docs.withColumn("_t", T.tokens(F.col("text"))).withColumn("shingles", T.shingles(F.col("_t")))


@query(f"WITH {SHINGLED} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(s) AS BIGINT) AS n_shingles FROM sh")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(spark, sf_dir).select("doc_id", F.size("_t").cast("long").alias("n_tokens"), F.size("shingles").cast("long").alias("n_shingles"))


BANDS_SQL = f"""
{SHINGLED},
h AS (SELECT doc_id, CAST('0x' || substr(sha256(unnest(s)), 1, 16) AS UBIGINT) AS v FROM sh),
c AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((v >> {b}) & 1) AS b{b}" for b in range(64))} FROM h GROUP BY doc_id),
a AS (SELECT doc_id, n, {", ".join(f"b{b}" for b in range(64))} FROM c UNION ALL SELECT doc_id, 0, {", ".join("0" for _ in range(64))} FROM sh WHERE len(s) = 0),
bands AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS band, CAST({' + '.join(f'CASE WHEN 2 * b{16 * k + i} >= n THEN {1 << i} ELSE 0 END' for i in range(16))} AS BIGINT) AS value FROM a" for k in range(4))})
"""


@query(f"WITH {BANDS_SQL} SELECT doc_id, CAST(band AS BIGINT) AS band, value FROM bands")
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.band_keys(_shingled(spark, sf_dir), "doc_id").select("doc_id", long("band"), long("value"))


PAIRS_SQL = f"""
{BANDS_SQL},
blocks AS (SELECT doc_id, 'b' || band || ':' || value AS block FROM bands UNION ALL SELECT doc_id, 't:' || {NORMAL} FROM documents),
pairs AS (SELECT DISTINCT a.doc_id, b.doc_id AS other FROM blocks a JOIN blocks b USING (block) WHERE a.doc_id > b.doc_id),
jac AS (SELECT p.doc_id, p.other, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) AS u FROM pairs p JOIN sh x ON p.doc_id = x.doc_id JOIN sh y ON p.other = y.doc_id)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(spark, sf_dir).select("doc_id", "text", F.col("text").alias("template"), "shingles")


@query(f"WITH {PAIRS_SQL} SELECT doc_id, other FROM pairs")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return novelty.shortlist(index, index, "doc_id", "other", itself=True)


@query(f"WITH {PAIRS_SQL} SELECT doc_id, other, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 6) AS jaccard FROM jac WHERE CASE WHEN u = 0 THEN 1.0 ELSE i / u END >= {NEAR} - 0.2")
def near_dups_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism).select("doc_id", T.tokens(ids.normalized(F.col("text"))).alias("_t"))
    pairs = novelty.similar_sets(docs, "doc_id", "_t", NEAR - 0.2, lambda df: tables.scratch(spark, df, "near"))
    return pairs.select("doc_id", "other", F.round("jaccard", 6).alias("jaccard"))


@query()
def near_dups_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that share a block, by Jaccard and matching blocks: all pairs of different texts, each under its smallest key, and for every other turn of a text a row with that key (copy)."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("key"), "text")
    index = turns.select("key", ids.normalized(F.col("text")).alias("text"), T.template(F.col("text")).alias("template"))
    return novelty.similar_texts(index, "key", max(0.0, 0.2 - 0.2), lambda df: tables.scratch(spark, df, "near"))


CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g'), '[A-Za-z]+|\p{Nd}+|[^\p{L}\p{N}_\s]') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g'), '[A-Za-z]+|\p{Nd}+|[^\p{L}\p{N}_\s]') w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s FROM d WHERE len(w) >= 3),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s FROM b WHERE len(w) >= 3),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS containment FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) / any_value(n) >= 0.85
"""


@query(CONTAINED_SQL)
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most shingles of a parent text: an equi-join on shingles, so nothing is compared that shares none."""

    def rows(name: str, key: str) -> DataFrame:
        plain = read(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism).select(key, F.regexp_replace(ids.normalized(F.col("text")), "[0-9]+", "#").alias("_x"))
        words = plain.select(key, T.tokens(F.col("_x")).alias("_t")).where(F.size("_t") >= T.WIDTH)
        return words.select(key, T.shingles(F.col("_t")).alias("_s")).select(key, F.explode_outer("_s").alias("s"))

    parent = rows("benchmark", "item_id")
    size = parent.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = rows("documents", "doc_id").join(parent, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(size, "item_id")
    found = shared.withColumn("c", F.col("shared") / F.col("n")).where((F.col("shared") >= SHARED) & (F.col("c") >= CONTAINMENT))
    return found.select("doc_id", "item_id", "shared", F.round("c", 6).alias("containment"))


# --- scores -----------------------------------------------------------------------------------------------------------

SCORES = """
s AS (SELECT l_orderkey AS problem_id, count(*) AS n, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS k, sum(l_discount * 10 + 0.0) AS u FROM lineitem GROUP BY 1),
r AS (SELECT problem_id, n, CASE WHEN n = 8 THEN k END AS k, CASE WHEN n = 8 THEN k / 8.0 END AS s_hat, CASE WHEN n = 8 THEN 8 / 7.0 * (k / 8.0) * (1 - k / 8.0) END AS learn, CASE WHEN n = 8 THEN u / 8.0 END AS u, CASE WHEN n <> 8 THEN 'incomplete_score_group' END AS reason FROM s)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem_id"), "l_returnflag", "l_discount")
    return scoring.score_groups(rows, ["problem_id"], F.col("l_returnflag") == "N", F.col("l_discount") * 10 + 0.0, F.lit(True))


@query(f"WITH {SCORES} SELECT problem_id, CAST(k AS BIGINT) AS num_correct, round(CAST(s_hat AS DOUBLE), 9) AS s_hat, round(CAST(learn AS DOUBLE), 9) AS learnability, round(u, 9) AS u_score, round(CAST(learn AS DOUBLE) * u, 9) AS rq_score FROM r WHERE reason IS NULL")
def rq_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _scores(spark, sf_dir).where("reason is null")
    return good.select("problem_id", "num_correct", *(F.round(c, 9).alias(c) for c in ("s_hat", "learnability", "u_score", "rq_score")))


@query(f"WITH {SCORES} SELECT n, reason, count(*) AS n_groups FROM r WHERE reason IS NOT NULL GROUP BY 1, 2")
def score_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("reason is not null").groupBy("n", "reason").agg(F.count("*").alias("n_groups"))


@query(f"WITH {SCORES}, f AS (SELECT problem_id % 5 AS cell, count(*) AS c FROM r WHERE s_hat > {BAND[0]} AND s_hat < {BAND[1]} GROUP BY 1) SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS frontier_count, CAST(coalesce(sum(least(c, 8)), 0) AS BIGINT) AS frontier_capacity FROM f")
def frontier_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _scores(spark, sf_dir).where(scoring.in_band(F.col("s_hat"))).withColumn("cell", F.col("problem_id") % 5)
    return scoring.capacity(inside, "cell", 8)


@query("SELECT doc_id, CASE WHEN n_chars >= 4096 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN n_chars >= 4096 THEN 'max_tokens_reached' END AS reject_reason FROM documents")
def overlong_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, reason = scoring.overlong(F.col("n_chars"), 4096)
    return read(spark, sf_dir, "documents").select("doc_id", status.alias("status"), reason.alias("reject_reason"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 1.0 ELSE 0.0 END AS score, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 1.0 ELSE 0.0 END AS accuracy, CASE WHEN o_orderpriority <> '5-LOW' THEN 1.0 ELSE 0.0 END AS format FROM orders".replace("1.0 ELSE 0.0 END", "1e0 ELSE 0e0 END"))
def reward_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("hit"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("box"))
    return scoring.rewards(rows, "hit", "box").select("o_orderkey", "score", "accuracy", "format")


# --- labels -----------------------------------------------------------------------------------------------------------

VOTES_SQL = """
WITH g AS (SELECT o_custkey AS group_id, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT o_custkey AS group_id, o_orderpriority AS a, count(*) AS k FROM orders GROUP BY 1, 2),
t AS (SELECT group_id, count(*) AS n_clusters, max(k) AS top FROM c GROUP BY 1),
w AS (SELECT t.*, (SELECT count(*) FROM c WHERE c.group_id = t.group_id AND c.k = t.top) AS ties, (SELECT max(a) FROM c WHERE c.group_id = t.group_id AND c.k = t.top) AS best FROM t),
r AS (SELECT g.n, w.*, CASE WHEN n <> 9 THEN 'incomplete_label_group' WHEN ties > 1 THEN 'label_tie' END AS reason FROM g JOIN w USING (group_id))
SELECT group_id, n, CASE WHEN n = 9 THEN n_clusters ELSE 0 END AS n_clusters, CASE WHEN reason IS NULL THEN best END AS label, CASE WHEN n = 9 THEN top ELSE 0 END AS winner_size, CAST(CASE WHEN n = 9 THEN round(top / 9, 6) ELSE 0 END AS DOUBLE) AS agreement, reason FROM r
"""


@query(VOTES_SQL)
def plurality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), "o_orderpriority", "o_orderkey")
    out = labeling.plurality(rows, "group_id", F.col("o_orderpriority"), F.col("o_orderkey"))
    return out.select("group_id", "n", long("n_clusters"), "label", long("winner_size"), F.round("agreement", 6).alias("agreement"), "reason")


@query("SELECT o_custkey AS group_id, 'status' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1, 3 UNION ALL SELECT o_custkey, 'reason', o_orderpriority, count(*) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1, 3")
def group_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"))
    found = labeling.diagnostics(rows, "group_id", "status", "reason")
    one = lambda kind: found.select("group_id", F.lit(kind).alias("kind"), F.explode_outer(f"{kind}_counts").alias("x")).select("group_id", "kind", F.col("x.name").alias("name"), F.col("x.n").alias("n"))
    return one("status").unionByName(one("reason"))


@query("SELECT l_orderkey AS group_id, count(*) AS taken, max(seq) AS last_seq FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq FROM lineitem WHERE l_returnflag <> 'R') WHERE seq < 3 GROUP BY 1")
def first_needed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "group_id")
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    kept = tables.first_needed(rows, "group_id", order, F.col("l_returnflag") != "R", 3)
    return kept.groupBy("group_id").agg(F.count("*").alias("taken"), F.max("sample_seq").cast("long").alias("last_seq"))


# --- tables -----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) k FROM orders) WHERE k = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    there = orders.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    new = tables.append_new(there, orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")])
    return new.select("o_custkey", "o_orderkey", "o_totalprice")


EVENT_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of users by day: success rate, score, cell."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("problem_id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), (F.col("event_type") == "view").cast("int").alias("hit"), F.floor(F.col("value") * 100).alias("cents"))
    first = rows.agg(F.min("day").alias("_first"))
    daily = rows.groupBy("problem_id", "day").agg(F.round(F.avg("hit"), 6).alias("s_hat"), F.sum("cents").cast("long").alias("rq"))
    return daily.join(F.broadcast(first)).select("problem_id", (F.col("day") - F.col("_first")).alias("iteration"), "s_hat", "rq", (F.col("problem_id") % 5).alias("cell"))


DAILY = f"""
e AS (SELECT user_id AS problem_id, {EVENT_DAY} AS day, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS hit, CAST(floor(value * 100) AS BIGINT) AS cents FROM events),
daily AS (SELECT problem_id, day - (SELECT min(day) FROM e) AS iteration, round(avg(hit), 6) AS s_hat, CAST(sum(cents) AS BIGINT) AS rq, problem_id % 5 AS cell FROM e GROUP BY problem_id, day)
"""


@query(f"WITH {DAILY} SELECT problem_id, max(iteration) AS iteration, arg_max(s_hat, iteration) AS s_hat FROM daily GROUP BY 1")
def latest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.latest_scores(_daily(spark, sf_dir).withColumn("policy_version", F.lit(0))).select("problem_id", "iteration", "s_hat")


@query(f"WITH {DAILY} SELECT problem_id, max(iteration) AS iteration, arg_max(rq, iteration) AS rq FROM daily WHERE iteration <= {DAY} GROUP BY 1")
def score_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.score_as_of(_daily(spark, sf_dir).withColumn("policy_version", F.lit(0)), DAY).select("problem_id", "iteration", "rq")


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1")
def score_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tables.keep_last(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value", "event_id")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 8 AS group_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS sample_index, o_orderkey FROM orders WHERE (SELECT count(*) FROM orders) % 8 = 0")
def instance_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in request order cut into groups of eight. The index is the rank of the key: ranges of keys are ranked alone and shifted by the rows before them."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    total = orders.count()
    ranked = global_index(orders, "o_orderkey", "row_index")
    return tables.slices(ranked, "row_index", total // 8, 8).select("group_id", "sample_index", "o_orderkey")


def global_index(df: DataFrame, key: str, out: str, width: int = 4096) -> DataFrame:
    """df with the rank of a long key from 0, by blocks of keys, so that no task orders all rows. Keys must be unique."""
    from pyspark.sql import Window

    blocks = df.withColumn("_b", F.expr(f"{key} div {width}"))
    before = blocks.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1 + F.col("_before")
    return blocks.join(before, "_b").withColumn(out, place.cast("long")).drop("_b", "_before")


# --- selections -------------------------------------------------------------------------------------------------------

FRONTIER = f"""
{DAILY},
f AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rq DESC, problem_id) AS rn FROM daily WHERE iteration = {DAY} AND s_hat > {BAND[0]} AND s_hat < {BAND[1]}),
capped AS (SELECT * FROM f WHERE rn <= 8),
named AS (SELECT cell, (row_number() OVER (ORDER BY cell) - 1 - {OFFSET} + 10 * count(*) OVER ()) % count(*) OVER () AS turn FROM (SELECT DISTINCT cell FROM capped)),
seats AS (SELECT capped.*, row_number() OVER (ORDER BY rn, turn) AS seat FROM capped JOIN named USING (cell)),
lagged AS (SELECT * FROM seats WHERE seat <= {CHOSEN} AND (SELECT count(*) FROM seats) >= {CHOSEN})
"""


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.lagged_frontier(_daily(spark, sf_dir).where(F.col("iteration") == DAY), "cell", "problem_id", "rq", "s_hat", CHOSEN, 8, OFFSET)


@query(f"WITH {FRONTIER} SELECT CAST(seat AS BIGINT) AS seat, problem_id, cell, rq FROM lagged")
def lagged_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lagged(spark, sf_dir).select(long("seat"), "problem_id", "cell", "rq")


@query(f"WITH {FRONTIER} SELECT l.problem_id, l.rq AS selection_rq, n.rq AS current_rq, n.s_hat AS current_s FROM lagged l JOIN daily n ON n.problem_id = l.problem_id AND n.iteration = {DAY + 1}")
def lagged_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _daily(spark, sf_dir).where(F.col("iteration") == DAY + 1).select("problem_id", F.col("rq").alias("current_rq"), F.col("s_hat").alias("current_s"))
    chosen = _lagged(spark, sf_dir).select("problem_id", F.col("rq").alias("selection_rq"))
    return selection.with_current(chosen, now, "problem_id").select("problem_id", "selection_rq", "current_rq", "current_s")


REMEASURE = f"""
{DAILY},
latest AS (SELECT problem_id, cell, max(iteration) AS policy, arg_max(s_hat, iteration) AS s_hat, min(iteration) AS created FROM daily GROUP BY 1, 2),
stale AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN s_hat > {BAND[0]} AND s_hat < {BAND[1]} THEN 0 ELSE 1 END, policy, created, problem_id) AS rn FROM latest WHERE policy <> (SELECT max(iteration) FROM daily)),
again AS (SELECT *, row_number() OVER (ORDER BY rn, cell) AS seat FROM stale QUALIFY seat <= 64)
"""


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    latest = daily.groupBy("problem_id", "cell").agg(F.max("iteration").alias("policy"), F.max_by("s_hat", "iteration").alias("s_hat"), F.min("iteration").alias("created"))
    last = daily.agg(F.max("iteration")).first()[0]
    return selection.remeasure(latest, last if last is not None else -1, "cell", "problem_id", "s_hat", "policy", "created")


@query(f"WITH {REMEASURE} SELECT CAST(seat AS BIGINT) AS seat, problem_id, cell FROM again")
def remeasure_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).select(long("seat"), "problem_id", "cell")


@query(f"WITH {FRONTIER}, latest AS (SELECT problem_id, cell, max(iteration) AS policy, arg_max(s_hat, iteration) AS s_hat, min(iteration) AS created FROM daily GROUP BY 1, 2), stale AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN s_hat > {BAND[0]} AND s_hat < {BAND[1]} THEN 0 ELSE 1 END, policy, created, problem_id) AS rn FROM latest WHERE policy <> (SELECT max(iteration) FROM daily)), again AS (SELECT *, row_number() OVER (ORDER BY rn, cell) AS seat FROM stale QUALIFY seat <= 64) SELECT problem_id, CAST(0 AS BIGINT) AS wave FROM lagged UNION ALL SELECT problem_id, 1 FROM again WHERE problem_id NOT IN (SELECT problem_id FROM lagged)")
def score_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.targets(_lagged(spark, sf_dir), _again(spark, sf_dir), "problem_id").select("problem_id", long("wave"))


BATCH_SQL = f"""
{DAILY},
f AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rq DESC, problem_id, iteration) AS rn FROM daily WHERE iteration = {DAY} AND s_hat > {BAND[0]} AND s_hat < {BAND[1]}),
turns AS (SELECT cell, row_number() OVER (ORDER BY max(rq) DESC, cell) AS turn FROM f WHERE rn <= 8 GROUP BY cell),
seats AS (SELECT f.*, row_number() OVER (ORDER BY rn, turn) AS seat FROM f JOIN turns USING (cell) WHERE rn <= 8),
batch AS (SELECT * FROM seats WHERE seat <= {CHOSEN} AND (SELECT count(*) FROM seats) >= {CHOSEN})
"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir).where(F.col("iteration") == DAY)
    return selection.batch_selection(rows, "cell", "problem_id", "iteration", "rq", "s_hat", CHOSEN, 8)


@query(f"WITH {BATCH_SQL} SELECT CAST(seat AS BIGINT) AS seat, problem_id, cell, rq FROM batch")
def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select(long("seat"), "problem_id", "cell", "rq")


@query(f"""WITH {BATCH_SQL} SELECT sha256('{{"iteration":{DAY},"kind":"score_replay_batch","observation_ids":' || '[' || coalesce(string_agg('"' || problem_id || '"', ',' ORDER BY seat), '') || '],"policy_version":3}}') AS batch_id, count(*) AS n FROM batch""")
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.batch_id(_batch(spark, sf_dir), DAY, 3, observation="problem_id").select("batch_id", long("n"))


@query(f"WITH {BATCH_SQL}, resident AS (SELECT DISTINCT problem_id FROM daily WHERE iteration = {DAY + 1}) SELECT CAST(problem_id AS VARCHAR) AS key, 'not_resident' AS fault FROM batch WHERE problem_id NOT IN (SELECT problem_id FROM resident) UNION ALL SELECT '*', 'size' FROM (SELECT count(*) AS n FROM batch) WHERE n <> {CHOSEN}")
def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _daily(spark, sf_dir).where(F.col("iteration") == DAY + 1).select("problem_id").distinct()
    return audit.batch_checks(_batch(spark, sf_dir), there, "problem_id", "problem_id", CHOSEN)


@query(f"WITH {DAILY}, p AS (SELECT problem_id, iteration, lag(iteration) OVER (PARTITION BY problem_id ORDER BY iteration) AS before FROM daily) SELECT problem_id, iteration, before FROM p WHERE before IS NOT NULL AND iteration <> before + 1")
def policy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.policy_steps(_daily(spark, sf_dir).select("problem_id", "iteration"), "iteration", "iteration", "problem_id")


@query("SELECT CAST(user_id AS VARCHAR) AS key, 'policy_changed' AS fault FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def policy_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.one_policy(read(spark, sf_dir, "events"), "user_id", "event_type")


# --- lineage and pairs ------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey AS block, [s_nationkey, 100 + s_suppkey % 7] AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT a.block, a.s_suppkey AS \"left\", b.s_suppkey AS \"right\" FROM s a JOIN s b ON a.block = b.block AND a.s_suppkey < b.s_suppkey WHERE NOT list_has_any(a.r, b.r)")
def lineage_disjoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("block"))
    rows = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("block", "s_suppkey", F.array(F.col("s_nationkey").cast("long"), 100 + F.col("s_suppkey") % 7).alias("roots"))
    return grid.disjoint_pairs(rows, "s_suppkey", "roots", "block")


@query("SELECT l_orderkey AS id, l_linenumber AS line, array_to_string(list_sort(list_distinct([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)])), ',') AS roots, CAST(greatest(l_partkey % 4, l_suppkey % 4) + 1 AS BIGINT) AS generation, count(*) AS n FROM lineitem GROUP BY ALL")
def lineage_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"))
    known = pairs.select(F.col("left_id").alias("id")).unionByName(pairs.select(F.col("right_id").alias("id"))).distinct()
    parents = known.select("id", F.lit(None).cast("array<string>").alias("roots"), (F.col("id") % 4).alias("generation"))
    out = grid.lineage(pairs, parents).select(F.col("id.l_orderkey").alias("id"), F.col("id.l_linenumber").alias("line"), F.array_join("roots", ",").alias("roots"), long("generation"))
    return out.groupBy("id", "line", "roots", "generation").agg(F.count("*").alias("n"))


@query()
def parent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _problems(spark, sf_dir).withColumn("roots", F.array(F.col("problem_id").cast("string")))
    return pairing.sample_pairs(rows, "problem_id", "cell", "roots", 32, 42)


# --- gates ------------------------------------------------------------------------------------------------------------

GATES_SQL = """
WITH g AS (SELECT d.doc_id, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 1 WHEN n_chars NOT BETWEEN 20 AND 4000 THEN 2 WHEN quality = 0 THEN 3 ELSE 4 END AS stop,
  CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown_language' WHEN n_chars NOT BETWEEN 20 AND 4000 THEN 'question_length_out_of_bounds' WHEN quality = 0 THEN 'low_quality' END AS reason FROM documents d LEFT JOIN labels USING (doc_id)),
e AS (SELECT p AS phase, CASE WHEN k = stop THEN 'rejected' ELSE 'passed' END AS status, CASE WHEN k = stop THEN reason END AS reason FROM g, (VALUES (1, 'language'), (2, 'length'), (3, 'quality')) v(k, p) WHERE k <= stop)
SELECT phase, status, reason, count(*) AS n FROM e GROUP BY ALL
"""


@query(GATES_SQL)
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    failure = gates.first_failure([
        ("language", F.when(~F.col("lang").isin("en", "fr", "de"), "unknown_language")),
        ("length", F.when(~F.col("n_chars").between(20, 4000), "question_length_out_of_bounds")),
        ("quality", F.when(F.col("quality") == 0, "low_quality")),
    ])
    return gates.funnel(gates.events(docs.withColumn("failure", failure), "doc_id", ["language", "length", "quality"]))


# --- replay -----------------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, sha256('[{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}]') AS prompt_sha, sha256('{"answer":' || CAST(to_json(text) AS VARCHAR) || '}') AS answer_sha, sha256('{"verifier":{"mode":' || CAST(to_json(role) AS VARCHAR) || '}}') AS verifier_sha FROM conversations""")
def replay_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    messages = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    return turns.select("conv_id", "turn", replay.prompt_hash(messages).alias("prompt_sha"), replay.answer_hash(F.col("text")).alias("answer_sha"), replay.verifier_hash(F.col("role"), F.lit(None).cast("array<string>")).alias("verifier_sha"))


@query("SELECT o_custkey AS group_id, CASE WHEN lo IS NOT DISTINCT FROM hi THEN coalesce(lo, 0) END AS rows, CASE WHEN lo <> hi THEN 'inconsistent_row_counts' END AS fault FROM (SELECT o_custkey, min(nullif(o_orderkey % 3, 0)) AS lo, max(nullif(o_orderkey % 3, 0)) AS hi FROM orders GROUP BY 1)")
def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 3).alias("size"))
    return replay.payload_rows(rows, "group_id", "size")


CALLS_SQL = "r AS (SELECT l_orderkey AS call, count(*) AS rows, CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 0 THEN 'passthrough' WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = count(*) THEN 'served' ELSE 'failed' END AS route FROM lineitem GROUP BY 1)"


@query(f"WITH {CALLS_SQL} SELECT * FROM r")
def replay_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.routed(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), (F.col("l_linestatus") == "O").alias("marked")), "call", "marked")


@query(f"WITH {CALLS_SQL}, g AS (SELECT count(*) AS captured_groups, CAST(sum(p_size) AS BIGINT) AS captured_rows FROM part) SELECT g.*, s.* FROM g, (SELECT count(*) FILTER (route = 'served') AS served_batches, CAST(coalesce(sum(rows // 2) FILTER (route = 'served'), 0) AS BIGINT) AS served_groups, CAST(coalesce(sum(rows) FILTER (route = 'served'), 0) AS BIGINT) AS served_rows, count(*) FILTER (route = 'passthrough') AS passthrough_calls, count(*) FILTER (route = 'failed') AS failed_calls FROM r) s")
def replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.stats(read(spark, sf_dir, "part").withColumnRenamed("p_size", "payload_rows"), replay_routes(spark, sf_dir), 2)


@query(f"WITH {BATCH_SQL} SELECT CAST(seat AS BIGINT) AS seat, CAST(i AS BIGINT) AS sample_index, problem_id, rq FROM batch, (SELECT unnest(range(0, 8)) AS i)")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = _batch(spark, sf_dir).select("problem_id", "seat")
    groups = _daily(spark, sf_dir).where(F.col("iteration") == DAY).select("problem_id", "rq")
    return replay.dataset_rows(batch, groups, "problem_id", 8).select(long("seat"), long("sample_index"), "problem_id", "rq")


@query(f"WITH u AS (SELECT {EVENT_DAY} AS day, user_id, count(*) FILTER (event_type = 'signup') AS u, count(*) FILTER (event_type = 'view') AS s FROM events GROUP BY 1, 2) SELECT user_id || '/' || day AS key, CASE WHEN u > 1 THEN 'several_updates' WHEN s > 1 THEN 'several_batches' WHEN u > s THEN 'update_without_batch' ELSE 'batch_not_consumed' END AS fault FROM u WHERE u > 1 OR s > 1 OR u <> s")
def consumed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))).alias("iteration"), "event_type")
    return replay.consumed_once(days.where("event_type = 'view'"), days.where("event_type = 'signup'"))


@query("SELECT o_orderpriority AS wave, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS parsed, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS labelled FROM orders GROUP BY 1")
def wave_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("wave"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderstatus").alias("phase"), F.lit("passed").alias("status"))
    return replay.wave_funnel(log, "wave", {"parsed": "O", "labelled": "F"})


# --- checks over tables --------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT problem_id, iteration, rq FROM daily WHERE iteration = {DAY}")
def score_at_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir).withColumn("policy_version", F.lit(0)).withColumn("observation_id", F.col("problem_id"))
    return grid.scores_at(rows, DAY).select("problem_id", "iteration", "rq")


@query("SELECT user_id AS problem_id, side FROM (SELECT user_id, 'left' AS side FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click') UNION ALL SELECT user_id, 'right' FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view'))")
def authorised_and_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one table has and the other lacks, as multisets."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("problem_id"), "event_type")
    return tables.same_keys(events.where("event_type = 'view'").select("problem_id"), events.where("event_type = 'click'").select("problem_id"), "problem_id")


@query(f"""WITH {DAILY}, c AS (SELECT problem_id, iteration, s_hat, lag(iteration) OVER d AS si, lag(s_hat) OVER d AS ss FROM daily WINDOW d AS (PARTITION BY problem_id ORDER BY iteration))
SELECT CAST(problem_id AS VARCHAR) || '/' || iteration AS key, 'lag' AS fault FROM c WHERE si IS NULL""")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users as candidates whose selection evidence is that of the day before: the first day has none."""
    from pyspark.sql import Window

    before = Window.partitionBy("problem_id").orderBy("iteration")
    rows = _daily(spark, sf_dir).select(F.concat_ws("/", "problem_id", "iteration").alias("observation_id"), F.col("problem_id").cast("string").alias("problem_id"), F.col("s_hat").alias("current_s"), F.col("iteration").alias("score_iteration"), F.lag("iteration").over(before).alias("selection_iteration"), F.lag("s_hat").over(before).alias("selection_s"))
    return audit.candidate_checks(rows, 1)


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS h, bool_and(l_linestatus = 'O') AS m FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS key, fault FROM g, (SELECT unnest(['group_size', 'one_payload', 'marked']) AS fault) WHERE (fault = 'group_size' AND n <> 4) OR (fault = 'one_payload' AND h <> 1) OR (fault = 'marked' AND NOT m)
UNION ALL SELECT '*', 'groups' FROM (SELECT count(*) AS n FROM g) WHERE n <> 32""")
def served_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("observation_id"), F.col("l_returnflag").alias("payload_hash"), (F.col("l_linestatus") == "O").alias("marked"))
    return audit.served_checks(rows, 32, 4)


@query("SELECT '*' AS key, fault FROM (SELECT count(DISTINCT p_brand) AS p, count(DISTINCT p_type) AS i, min(p_size) AS a, max(p_size) AS b, count(*) AS n, count(DISTINCT p_partkey) AS o FROM part), (SELECT unnest(['policy', 'iteration', 'group_size', 'observations']) AS fault) WHERE (fault = 'policy' AND p > 1) OR (fault = 'iteration' AND i > 1) OR (fault = 'group_size' AND (a <> 8 OR b <> 8)) OR (fault = 'observations' AND o <> n)")
def buffer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("policy"), F.col("p_type").alias("iteration"), F.col("p_size").alias("payload_rows"), F.col("p_partkey").alias("observation_id"))
    return audit.buffer_checks(rows)


@query("""SELECT CAST(conv_id AS VARCHAR) AS key, fault FROM (SELECT conv_id, count(DISTINCT nullif(text, '')) AS p, count(CASE WHEN role = 'user' THEN 1 END) AS n, count(*) AS c FROM conversations GROUP BY 1), (SELECT unnest(['one_prompt', 'one_kind']) AS fault) WHERE (fault = 'one_prompt' AND p > 1) OR (fault = 'one_kind' AND n <> 0 AND n <> c)""")
def fragment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as groups put together from attempts: one prompt each, and payloads of all turns or of none."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("prompt_hash"), F.when(F.col("role") == "user", F.col("turn")).alias("payload_row"))
    return groups.fragment_faults(rows, "conv_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) - 1 AS BIGINT) AS sample_index, text FROM conversations")
def fragments_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("request_id"), (F.col("turn") % 2).alias("attempt"), F.col("turn").alias("sample_index"), "text")
    return groups.together(rows).select("request_id", long("sample_index"), "text")


@query("SELECT l_orderkey AS request_id, collected, CASE WHEN collected < 4 THEN 'retrying' ELSE 'complete' END AS status, CASE WHEN collected < 4 THEN 'incomplete_label_group' END AS reason FROM (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS collected FROM lineitem GROUP BY 1)")
def label_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_linestatus") == "O", "accepted").otherwise("rejected").alias("status"))
    return groups.label_statuses(rows, "request_id", 0, 2, 4)
