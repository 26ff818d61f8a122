"""The queries of the reference's operators, and the SQL that states the same.

Views over the test tables: ``events`` is a command log (error deletes, view
reads, the rest sets ``props``) and a heartbeat stream; nodes of replicas are
users modulo seven, replica A holding the first 70 % of events; ``nation`` is
the ring, ``customer`` its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import new_path, written
from .operators import kv, liveness, peers, replica, ring, store
from .streaming import stateful

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}

_LOG = """WITH cmdlog AS (
  SELECT event_id + 1 AS version, event_id // 10 AS txn_id, event_id % 10 AS ord, 'u:' || user_id AS key,
    CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'del' ELSE 'set' END AS op,
    CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE props END AS value FROM events
), w AS (SELECT * FROM cmdlog WHERE op <> 'get'),
cur AS (SELECT key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM w) WHERE r = 1 AND value IS NOT NULL),
mid AS (SELECT max(txn_id) // 2 AS t FROM cmdlog),
half AS (SELECT key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM w, mid WHERE txn_id <= t) WHERE r = 1 AND value IS NOT NULL),
batch AS (SELECT * FROM (VALUES (0, 'u:1', 'a'), (1, 'new', 'b'), (2, 'u:2', NULL), (3, 'u:1', ''), (4, 'absent', NULL), (5, 'new', 'c')) t(ord, key, value)),
pick AS (SELECT * FROM (VALUES (0, 'u:3'), (1, 'nope'), (2, 'u:1'), (3, 'u:3'), (4, '')) t(ord, key)),
st AS (SELECT 'n' || (user_id % 7) AS node, 'u:' || user_id AS key, props AS value, event_id + 1 AS version FROM events),
b AS (SELECT node, key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY version DESC) AS r FROM st) WHERE r = 1),
a AS (SELECT node, key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY version DESC) AS r FROM st WHERE version <= (SELECT max(version) * 7 // 10 FROM st)) WHERE r = 1),
fl AS (SELECT node, max(version) AS max_version FROM a GROUP BY node),
stale AS (SELECT b.* FROM b LEFT JOIN fl USING (node) WHERE b.version > coalesce(fl.max_version, 0)),
beats AS (SELECT user_id AS node, epoch_us(ts) / 1e6 AS t FROM events),
nowt AS (SELECT max(t) AS now FROM beats),
iv AS (SELECT node, t, CASE WHEN gap <= 43200 THEN gap ELSE 21600 END AS sample FROM (SELECT *, t - lag(t) OVER (PARTITION BY node ORDER BY t) AS gap FROM beats) WHERE gap IS NOT NULL),
rm AS (SELECT *, avg(sample) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM iv),
ph AS (SELECT l.node, l.last, m.mean, (now - l.last) / m.mean AS phi FROM (SELECT node, max(t) AS last FROM beats GROUP BY node) l
  LEFT JOIN (SELECT node, mean FROM rm QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC) = 1) m USING (node), nowt),
cl AS (SELECT *, CASE WHEN phi > 3 THEN 'dead' WHEN phi IS NOT NULL THEN 'live' ELSE 'unknown' END AS status FROM ph),
rn AS (SELECT 'n' || n_nationkey AS node, n_nationkey % 4 + 1 AS n_replicas, n_nationkey % 3 <> 0 AS valid FROM nation),
vn AS (SELECT node, r::INTEGER AS replica, md5(node || '-' || r) AS pos, valid, row_number() OVER (ORDER BY md5(node || '-' || r)) - 1 AS i
  FROM (SELECT node, valid, unnest(range(n_replicas)) AS r FROM rn)),
ck AS (SELECT c_custkey, c_name AS key, md5(c_name) AS h FROM customer),
own AS (SELECT ck.c_custkey, ck.key, coalesce(vn.i, 0) AS i FROM ck ASOF LEFT JOIN vn ON ck.h <= vn.pos)
"""


def _query(sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _LOG + sql
        return f

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern is what Spark takes for a table of one file."""
    return s.readStream.schema(_table(s, d, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parquet*")


def command_log(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "view", "get").when(kind == "error", "del").otherwise("set")
    return _table(s, d, "events").select(
        (F.col("event_id") + 1).alias("version"), F.expr("event_id div 10").alias("txn_id"), (F.col("event_id") % 10).alias("ord"),
        F.concat(F.lit("u:"), "user_id").alias("key"), op.alias("op"), F.when(~kind.isin("view", "error"), F.col("props")).alias("value"),
    )


def _batch(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES (0, 'u:1', 'a'), (1, 'new', 'b'), (2, 'u:2', NULL), (3, 'u:1', ''), (4, 'absent', NULL), (5, 'new', 'c') t(ord, key, value)")


def _picked(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES (0, 'u:3'), (1, 'nope'), (2, 'u:1'), (3, 'u:3'), (4, '') t(ord, key)")


def _middle(s: SparkSession, d: str) -> int:
    return (command_log(s, d).agg(F.max("txn_id")).first()[0] or 0) // 2


@_query("SELECT key, value, version FROM cur")
def kv_current_state(s, d):
    return kv.state(command_log(s, d))


@_query("SELECT pick.ord, pick.key, cur.value FROM pick LEFT JOIN cur USING (key)")
def kv_get_multi(s, d):
    return kv.get_multi(kv.state(command_log(s, d)), _picked(s))


@_query("SELECT key, value FROM cur WHERE key = 'u:3'")
def kv_point_get(s, d):
    return kv.state(command_log(s, d)).where("key = 'u:3'").select("key", "value")


_SET = """SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS r
  FROM (SELECT -1 AS ord, key, value FROM {base} UNION ALL SELECT * FROM batch{where})) WHERE r = 1 AND value IS NOT NULL"""


@_query(_SET.format(base="cur", where=""))
def kv_set_batch(s, d):
    return kv.apply_batch(kv.state(command_log(s, d)), _batch(s))


@_query("SELECT key, value FROM cur WHERE key NOT IN (SELECT key FROM pick)")
def kv_del_multi(s, d):
    return kv.delete_keys(kv.state(command_log(s, d)), _picked(s))


@_query(_SET.format(base="cur", where=" WHERE ord = 0"))
def kv_upsert_single(s, d):
    return kv.apply_batch(kv.state(command_log(s, d)), _batch(s).where("ord = 0"))


@_query("""SELECT (SELECT count(*) FROM cur) AS keys_count, (SELECT coalesce(sum(strlen(value)), 0)::BIGINT FROM cur) AS values_size_in_bytes,
  (SELECT count(DISTINCT (txn_id, op = 'get')) FROM cmdlog) AS cmds_count""")
def kv_metrics(s, d):
    log = command_log(s, d)
    return kv.metrics(kv.state(log), log)


@_query("SELECT count(*) AS keys_count FROM cur")
def kv_keys_count_incremental(s, d):
    return kv.keys_count_steps(command_log(s, d))


@_query("""SELECT coalesce(sum(CASE WHEN prev IS NOT NULL THEN -strlen(prev) WHEN value IS NOT NULL THEN strlen(value) ELSE 0 END), 0)::BIGINT AS values_size
  FROM (SELECT value, lag(value) OVER (PARTITION BY key ORDER BY version) AS prev FROM w)""")
def kv_values_size_literal(s, d):
    return kv.values_size_literal(command_log(s, d))


@_query("SELECT CASE WHEN op = 'get' THEN 'get' ELSE 'set' END AS rpc, count(DISTINCT txn_id) AS cmds FROM cmdlog GROUP BY 1")
def kv_cmds_by_op(s, d):
    return command_log(s, d).groupBy(F.when(F.col("op") == "get", "get").otherwise("set").alias("rpc")).agg(F.countDistinct("txn_id").alias("cmds"))


@_query("""SELECT raw, string_split(raw, '=')[1] AS key, string_split(raw, '=')[2] AS value
  FROM (SELECT CASE event_id % 4 WHEN 0 THEN event_type || '=' || props WHEN 1 THEN event_type || '=' WHEN 2 THEN event_type ELSE '=' || props || '=x' END AS raw FROM events)""")
def kv_parse_pairs(s, d):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN event_type || '=' || props WHEN 1 THEN event_type || '=' WHEN 2 THEN event_type ELSE '=' || props || '=x' END")
    return kv.parse_pairs(_table(s, d, "events").select(raw.alias("raw")))


@_query("SELECT key, value, version FROM half")
def mvcc_snapshot_asof(s, d):
    return kv.state(command_log(s, d), _middle(s, d))


@_query("""SELECT key, half.value AS before, cur.value AS after, CASE WHEN half.value IS NULL THEN 'added' WHEN cur.value IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM half FULL JOIN cur USING (key) WHERE half.value IS DISTINCT FROM cur.value""")
def mvcc_snapshot_diff(s, d):
    log = command_log(s, d)
    return kv.snapshot_diff(kv.state(log, _middle(s, d)), kv.state(log))


@_query(_SET.format(base="half", where=""))
def mvcc_read_your_writes(s, d):
    return kv.apply_batch(kv.state(command_log(s, d), _middle(s, d)), _batch(s))


@_query("""SELECT key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM w WHERE txn_id % 5 <> 0) WHERE r = 1 AND value IS NOT NULL""")
def mvcc_rollback_excludes_txn(s, d):
    log = command_log(s, d)
    committed = log.select("txn_id").where("txn_id % 5 <> 0")
    return kv.latest(kv.writes(log, committed)).where("value is not null")


@_query("SELECT key, value, valid_from, valid_to FROM (SELECT key, value, version AS valid_from, lead(version) OVER (PARTITION BY key ORDER BY version) AS valid_to FROM w) WHERE value IS NOT NULL")
def mvcc_version_history(s, d):
    return kv.version_history(command_log(s, d))


def _sets(s, d):
    e = _table(s, d, "events")
    return e.select(F.concat(F.lit("n"), F.col("user_id") % 7).alias("node"), F.concat(F.lit("u:"), "user_id").alias("key"), F.col("props").alias("value"), (F.col("event_id") + 1).alias("version"))


def _state(rows):
    best = rows.groupBy("node", "key").agg(F.max(F.struct("version", "value")).alias("b"))
    return best.select("node", "key", F.col("b.value").alias("value"), F.col("b.version").alias("version"))


def _replicas(s, d):
    rows = _sets(s, d)
    cut = (rows.agg(F.max("version")).first()[0] or 0) * 7 // 10
    return _state(rows.where(F.col("version") <= cut)), _state(rows)


def _stale(s, d):
    a, b = _replicas(s, d)
    return replica.stale(b, replica.digest(a))


@_query("SELECT node, seq, value, row_number() OVER (PARTITION BY node ORDER BY seq) AS version FROM (SELECT 'n' || (user_id % 7) AS node, event_id AS seq, props AS value FROM events)")
def node_state_assign_versions(s, d):
    rows = _table(s, d, "events").select(F.concat(F.lit("n"), F.col("user_id") % 7).alias("node"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    return replica.assign_versions(rows)


@_query("SELECT doc_id, coalesce(strlen(text), 0) <= 500 AS accepted FROM documents")
def node_value_size_guard(s, d):
    return replica.oversized(_table(s, d, "documents").select("doc_id", F.col("text").alias("value"))).select("doc_id", "accepted")


@_query("SELECT node, max(version) AS max_version FROM b WHERE node <> 'n3' GROUP BY node")
def digest(s, d):
    return replica.digest(_replicas(s, d)[1], s.sql("SELECT 'n3' AS node"))


@_query("SELECT * FROM stale")
def stale_kvs(s, d):
    return _stale(s, d)


@_query("SELECT node, count(*) AS stale, row_number() OVER (ORDER BY count(*) DESC, node)::INTEGER AS place FROM stale GROUP BY node")
def stale_node_ranking(s, d):
    return replica.rank_stale(_stale(s, d))


@_query("""SELECT node, key, value, version, bytes::BIGINT AS bytes FROM (
  SELECT s.*, 2 + sum(strlen(key) + strlen(value) + 12 + CASE WHEN k = 1 THEN strlen(node) + 11 ELSE 0 END) OVER (ORDER BY n DESC, node, version) AS bytes
  FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY version) AS k FROM stale) s) WHERE bytes <= 600""")
def delta_budgeted(s, d):
    return replica.budgeted_delta(_stale(s, d), 600)


@_query("SELECT node, max(version) AS max_version FROM stale GROUP BY node")
def delta_node_max_version(s, d):
    return replica.digest(_stale(s, d))


@_query("""SELECT node, key, CASE WHEN s.version > a.version OR a.version IS NULL THEN s.value ELSE a.value END AS value, greatest(coalesce(a.version, 0), coalesce(s.version, 0)) AS version
  FROM a FULL JOIN stale s USING (node, key)""")
def apply_delta_lww(s, d):
    a, b = _replicas(s, d)
    return replica.apply_delta(a, replica.stale(b, replica.digest(a)))


_RUN = """SELECT s.*, 2 + sum(strlen(key) + coalesce(strlen(value), 0) + 12 + CASE WHEN k = 1 THEN strlen(node) + 11 ELSE 0 END) OVER (ORDER BY n DESC, node, version) AS bytes
  FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY version) AS k FROM {stale}) s"""


_SENT = f"""SELECT node, count(*) FILTER (bytes <= {{0}})::BIGINT AS n FROM ({_RUN.format(stale="stale")})
  GROUP BY node HAVING min(bytes) - arg_min(strlen(key) + strlen(value) + 12, k) <= {{0}}"""


@_query(_SENT.format(600))
def delta_nodes_budgeted(s, d):
    """Nodes of the message, with the rows each has in it."""
    return replica.delta(_stale(s, d), 600).nodes


@_query(_SENT.format(15))
def delta_header_only(s, d):
    """A budget of just the first node's header: a node without rows."""
    return replica.delta(_stale(s, d), 15).nodes


def _two_sided(s, d):
    """Replica A with the writes of even keys, B with those of odd ones, both with A's first part."""
    rows = _sets(s, d)
    a, _ = _replicas(s, d)
    odd = F.expr("cast(substring(key, 3) as long) % 2")
    return _state(a.unionByName(rows.where((odd == 0) & (F.col("node") < "n4")))), _state(a.unionByName(rows.where((odd == 1) & (F.col("node") >= "n4"))))


_SIDES = """, ea AS (SELECT node, key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY version DESC) AS r FROM (SELECT * FROM a UNION SELECT * FROM st WHERE user_id_of(key) % 2 = 0 AND node < 'n4')) WHERE r = 1),
eb AS (SELECT node, key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY version DESC) AS r FROM (SELECT * FROM a UNION SELECT * FROM st WHERE user_id_of(key) % 2 = 1 AND node >= 'n4')) WHERE r = 1),
da AS (SELECT node, max(version) AS m FROM ea WHERE node <> 'n6' GROUP BY node), db AS (SELECT node, max(version) AS m FROM eb WHERE node <> 'n1' GROUP BY node),
sb AS (SELECT eb.* FROM eb LEFT JOIN da USING (node) WHERE node <> 'n1' AND version > coalesce(m, 0)),
ra AS ({ra}),
fa AS (SELECT node, key, CASE WHEN r.version > e.version OR e.version IS NULL THEN r.value ELSE e.value END AS value, greatest(coalesce(e.version, 0), coalesce(r.version, 0)) AS version
  FROM ea e FULL JOIN (SELECT node, key, value, version FROM ra WHERE bytes <= 1500 - (SELECT 5 + sum(strlen(node) + 17) FROM db)) r USING (node, key)),
sa AS (SELECT fa.* FROM fa LEFT JOIN db USING (node) WHERE node <> 'n6' AND version > coalesce(m, 0)),
rb AS ({rb}),
fb AS (SELECT node, key, CASE WHEN r.version > e.version OR e.version IS NULL THEN r.value ELSE e.value END AS value, greatest(coalesce(e.version, 0), coalesce(r.version, 0)) AS version
  FROM eb e FULL JOIN (SELECT node, key, value, version FROM rb WHERE bytes <= 1499) r USING (node, key))
""".format(ra=_RUN.format(stale="sb"), rb=_RUN.format(stale="sa")).replace("user_id_of(key)", "substr(key, 3)::BIGINT")


@_query(_SIDES + "SELECT 'a' AS side, * FROM fa UNION ALL SELECT 'b', * FROM fb")
def reconcile_two_way(s, d):
    """Syn, SynAck and Ack in 1,500 bytes each; a holds n6 dead, b n1."""
    a, b = (written(x, "side") for x in _two_sided(s, d))
    dead = lambda n: s.sql(f"SELECT '{n}' AS node")
    done = replica.exchange(a, b, 1500, dead_a=dead("n6"), dead_b=dead("n1"))
    side = lambda x, n: x.where("key is not null").select(F.lit(n).alias("side"), *replica.COLUMNS)
    return side(done.a, "a").unionByName(side(done.b, "b"))


@_query("SELECT node, key, value, version FROM a")
def reconcile_bad_cluster(s, d):
    """Another cluster's Syn changes nothing."""
    a, b = _replicas(s, d)
    return replica.exchange(a, b, clusters=("one", "other")).a


@_query("SELECT 'default-cluster' AS cluster_id, node, max(version) AS max_version FROM b WHERE node <> 'n3' GROUP BY node")
def syn_message(s, d):
    return replica.syn(_replicas(s, d)[1], "default-cluster", s.sql("SELECT 'n3' AS node"))


@_query("SELECT node, count(*) AS stale, row_number() OVER (ORDER BY count(*) DESC, md5('7' || node), node)::INTEGER AS place FROM stale GROUP BY node")
def stale_node_ranking_seeded(s, d):
    return replica.rank_stale(_stale(s, d), seed=7)


@_query("SELECT value, version FROM b WHERE node = 'n3' AND key = 'u:3'")
def node_state_get(s, d):
    return replica.get(_replicas(s, d)[1], "n3", "u:3")


@_query("""SELECT node, key, value, version FROM a WHERE node <> 'n2' UNION ALL SELECT 'n9', NULL, NULL, 0""")
def node_state_create_remove(s, d):
    """A node known by name alone comes, another goes."""
    a, _ = _replicas(s, d)
    return replica.remove_nodes(replica.with_nodes(a, s.sql("SELECT 'n9' AS node UNION SELECT 'n1'")), s.sql("SELECT 'n2' AS node"))


@_query("""SELECT node, key, arg_max(value, version) AS value, max(version) AS version FROM (
  SELECT node, key, value, row_number() OVER (PARTITION BY node ORDER BY ord) AS version FROM (
    SELECT DISTINCT 'c' || c_nationkey AS node, -1 AS ord, 'heartbeat' AS key, '0' AS value FROM customer
    UNION ALL SELECT 'c' || c_nationkey, c_custkey, c_mktsegment, c_name FROM customer)) GROUP BY node, key""")
def node_initial_states(s, d):
    c = _table(s, d, "customer")
    return replica.initial_states(c.select(F.concat(F.lit("c"), "c_nationkey").alias("node"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value")))


@_query("""SELECT node, key, value, version FROM a UNION ALL
  SELECT node, 'heartbeat', n::VARCHAR, (coalesce(m, 0) + n)::BIGINT FROM (SELECT 'n' || (user_id % 7) AS node, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) t LEFT JOIN (SELECT node, max(version) AS m FROM a GROUP BY node) USING (node)""")
def node_heartbeats(s, d):
    ticks = _table(s, d, "events").where("event_type = 'click'").select(F.concat(F.lit("n"), F.col("user_id") % 7).alias("node"), F.lit(1).alias("beats"))
    return replica.beat(_replicas(s, d)[0], ticks)


@_query("SELECT node, key, value, version FROM b")
def reconcile_round(s, d):
    return replica.reconcile(*_replicas(s, d))


@_query("SELECT node, key, value, version FROM b")
def cluster_snapshot_nested(s, d):
    """The nested export, taken apart again: SQL has no maps to compare."""
    return replica.flattened(replica.nested(_replicas(s, d)[1]))


@_query("SELECT (5 + sum(strlen(node) + 17))::BIGINT AS bytes FROM fl")
def synack_sizes(s, d):
    return replica.syn_ack_sizes(replica.digest(_replicas(s, d)[0]))


CONF = liveness.LivenessConfig(threshold=3.0, window=10, max_interval=43_200.0, initial_interval=21_600.0, grace=86_400.0)


def _beats(s, d):
    return _table(s, d, "events").select(F.col("user_id").alias("node"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))


def _classified(s, d):
    beats = _beats(s, d)
    return liveness.classify(liveness.phi(beats, beats.agg(F.max("t").alias("now")), CONF), CONF)


@_query("SELECT s.node, s.max_version FROM (SELECT node, max(version) AS max_version FROM b GROUP BY node) s LEFT JOIN fl USING (node) WHERE s.max_version > coalesce(fl.max_version, 0)")
def heartbeat_detect(s, d):
    a, b = _replicas(s, d)
    return liveness.detect(replica.digest(a), replica.digest(b))


@_query("SELECT node, round(t, 6) AS t, round(sample, 6) AS sample FROM iv")
def heartbeat_intervals(s, d):
    return liveness.intervals(_beats(s, d), CONF).select("node", F.round("t", 6).alias("t"), F.round("sample", 6).alias("sample"))


@_query("SELECT node, round(t, 6) AS t, round(mean, 4) AS mean FROM rm")
def rolling_mean(s, d):
    return liveness.rolling_mean(liveness.intervals(_beats(s, d), CONF), CONF).select("node", F.round("t", 6).alias("t"), F.round("mean", 4).alias("mean"))


@_query("SELECT node, round(phi, 6) AS phi FROM ph")
def phi(s, d):
    return _classified(s, d).select("node", F.round("phi", 6).alias("phi"))


@_query("SELECT node, status FROM cl")
def liveness_status(s, d):
    return _classified(s, d).select("node", "status")


@_query("SELECT node, now - last >= 86400 AS removed FROM cl, nowt WHERE status = 'dead'")
def grace_gc(s, d):
    beats = _beats(s, d)
    dead = _classified(s, d).where("status = 'dead'").select("node", F.col("last").alias("dead_at"))
    return liveness.collect_garbage(dead, beats.agg(F.max("t").alias("now")), CONF).select("node", "removed")


_EPOCHS = """WITH RECURSIVE beats AS (SELECT user_id AS node, epoch_us(ts) / 1e6 AS t FROM events),
tk AS (SELECT first + 43200.0 * unnest(range(0, 1 + floor((final - first) / 43200.0)::BIGINT)) AS t FROM (SELECT floor(min(t)) AS first, max(t) AS final FROM beats)),
ev AS (SELECT node, t, 0 AS kind FROM beats UNION ALL SELECT node, tk.t, 1 FROM (SELECT DISTINCT node FROM beats) n, tk),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, kind) AS i FROM ev),
run AS (
  SELECT DISTINCT node, 0::BIGINT AS i, NULL::DOUBLE AS tick, []::DOUBLE[] AS smp, NULL::DOUBLE AS last, 'unknown' AS status, NULL::DOUBLE AS dead_at, 0 AS epoch, NULL::DOUBLE AS phi, FALSE AS changed FROM beats
  UNION ALL
  SELECT node, i + 1, t,
    CASE WHEN kind = 1 THEN CASE WHEN ph > 3 THEN []::DOUBLE[] ELSE smp END WHEN last IS NULL THEN smp
      ELSE list_append(smp, CASE WHEN t - last <= 43200 THEN t - last ELSE 21600 END)[-10:] END,
    CASE WHEN kind = 0 THEN t WHEN ph > 3 THEN NULL ELSE last END,
    CASE WHEN kind = 0 THEN status WHEN ph > 3 THEN 'dead' WHEN ph IS NOT NULL THEN 'live' WHEN status = 'dead' AND t - dead_at >= 86400 THEN 'removed' ELSE status END,
    CASE WHEN kind = 0 THEN dead_at WHEN ph > 3 THEN t WHEN ph IS NOT NULL THEN NULL ELSE dead_at END,
    epoch + CASE WHEN kind = 1 AND ph > 3 THEN 1 ELSE 0 END,
    ph, kind = 1 AND (ph > 3 OR (ph IS NOT NULL AND status <> 'live') OR (ph IS NULL AND status = 'dead' AND t - dead_at >= 86400)) IS TRUE
  FROM (SELECT r.node, r.i, r.smp, r.last, r.status, r.dead_at, r.epoch, o.t, o.kind, CASE WHEN o.kind = 1 AND len(r.smp) > 0 THEN (o.t - r.last) / list_avg(r.smp) END AS ph
    FROM run r JOIN o ON o.node = r.node AND o.i = r.i + 1)
), changes AS (SELECT node, tick, status, phi, (epoch - CASE WHEN status = 'dead' THEN 1 ELSE 0 END)::INTEGER AS epoch FROM run WHERE changed)
"""


def _plain(sql: str):
    """As ``_query``, for SQL with its own common tables."""

    def add(f: Q) -> Q:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _schedule(beats):
    first, final = beats.agg(F.floor(F.min("t")).cast("double"), F.max("t")).first()
    return liveness.Schedule(first or 0.0, 43_200.0, final or 0.0)


@_plain(_EPOCHS + "SELECT node, tick, status, round(phi, 6) AS phi, epoch FROM changes")
def liveness_epochs(s, d):
    """Deaths found at ticks restart windows: every change of status, with the epoch it belongs to."""
    beats = _beats(s, d)
    return liveness.transitions(beats, _schedule(beats), CONF).select("node", "tick", "status", F.round("phi", 6).alias("phi"), "epoch")


def _membership(s, d):
    beats = _beats(s, d)
    states = _table(s, d, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("key"), F.col("props").alias("value"), (F.col("event_id") + 1).alias("version"))
    return liveness.update_nodes(_state(states), beats, _schedule(beats), CONF, 3, "key = 'signup' AND version % 4 <> 0")


@_plain(_EPOCHS + """, moved AS (SELECT *, lag(status, 1, 'unknown') OVER (PARTITION BY node ORDER BY tick, status = 'removed') AS was FROM changes WHERE node <> 3),
st AS (SELECT user_id AS node, event_type AS key, max(event_id + 1) AS version FROM events GROUP BY ALL)
SELECT tick, node, CASE WHEN status = 'live' THEN 'joined' ELSE 'left' END AS change FROM moved
WHERE (was = 'live') <> (status = 'live') AND node IN (SELECT node FROM st WHERE key = 'signup' AND version % 4 <> 0)""")
def update_nodes_ready(s, d):
    """The feed of the ready set: who joined and left at which tick."""
    return _membership(s, d).ready


@_plain(_EPOCHS + """, final AS (SELECT node, arg_max(status, (tick, status = 'removed')) AS status FROM changes WHERE node <> 3 GROUP BY node)
SELECT user_id AS node, event_type AS key, arg_max(props, event_id) AS value, max(event_id + 1) AS version FROM events
WHERE user_id NOT IN (SELECT node FROM final WHERE status = 'removed') GROUP BY ALL""")
def update_nodes(s, d):
    """States after liveness updates at every tick, without removed nodes."""
    return _membership(s, d).states


@_query("SELECT node FROM cl WHERE status = 'live' AND node IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50)")
def ready_nodes(s, d):
    states = _table(s, d, "events").select(F.col("user_id").alias("node"), "event_type", "value")
    return liveness.ready(_classified(s, d).where("status = 'live'"), states, "event_type = 'signup' AND value > 50")


@_query("""SELECT tick, nodes FROM (SELECT *, lag(nodes) OVER (ORDER BY tick) AS before, row_number() OVER (ORDER BY tick) AS r FROM (
  SELECT event_id // 20 AS tick, coalesce(string_agg(DISTINCT 'n' || (user_id % 3), ',' ORDER BY 'n' || (user_id % 3)) FILTER (event_type = 'click'), '') AS nodes FROM events GROUP BY 1))
  WHERE r = 1 OR nodes <> before""")
def ready_change_feed(s, d):
    node = F.when(F.col("event_type") == "click", F.concat(F.lit("n"), F.col("user_id") % 3))
    return liveness.change_feed(_table(s, d, "events").select(F.expr("event_id div 20").alias("tick"), node.alias("node")))


@_query("SELECT node, key, value, version FROM b")
def stream_lww_equals_batch(s, d):
    """The writes as a stream: state is the last of each node and key."""
    e = _stream(s, d, "events")
    rows = e.select(F.concat(F.lit("n"), F.col("user_id") % 7).alias("node"), F.concat(F.lit("u:"), "user_id").alias("key"), F.col("props").alias("value"), (F.col("event_id") + 1).alias("version"))
    return stateful.to_table(stateful.lww(rows), new_path(s, "stream"), new_path(s, "stream-checkpoint"), "complete")


@_query("SELECT node, round(t, 6) AS t, round(sample, 6) AS sample, round(mean, 4) AS mean FROM rm")
def stream_rolling_mean(s, d):
    """The beats as a stream: each node's window is state."""
    e = _stream(s, d, "events")
    beats = e.select(F.col("user_id").alias("node"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    out = stateful.to_table(stateful.rolling_mean(beats, CONF), new_path(s, "stream"), new_path(s, "stream-checkpoint"))
    return out.select("node", F.round("t", 6).alias("t"), F.round("sample", 6).alias("sample"), F.round("mean", 4).alias("mean"))


@_query("""SELECT key, value FROM (VALUES ('a', '3'), ('c', ''), ('d', 'x')) t(key, value)""")
def store_commit_protocol(s, d):
    """A store through commits, a rollback and an open transaction: what a reader then sees."""
    db = store.Store(s, new_path(s, "store"))
    db.set([("a", "1"), ("b", "2"), ("a", "3"), ("c", "")])
    with db.write() as lost:
        lost.set("a", "lost").delete("c")
    db.set([("d", "x"), ("b", None)])
    return db.read().state().select("key", F.col("value").cast("string").alias("value"))


def _nodes(s, d):
    k = F.col("n_nationkey")
    return _table(s, d, "nation").select(F.concat(F.lit("n"), k).alias("node"), (k % 4 + 1).alias("n_replicas"), (k % 3 != 0).alias("valid"))


def _keys(s, d):
    return _table(s, d, "customer").select("c_custkey", F.col("c_name").alias("key"))


@_query("SELECT node, replica, pos FROM vn")
def ring_build(s, d):
    return ring.build(_nodes(s, d))


@_query("SELECT c_custkey, key, node FROM own JOIN vn USING (i)")
def ring_lookup(s, d):
    return ring.lookup(_keys(s, d), ring.build(_nodes(s, d)))


@_query("SELECT c_custkey, key, CASE WHEN valid THEN node END AS node FROM own JOIN vn USING (i)")
def ring_lookup_valid(s, d):
    """A key whose owner is not valid has no node."""
    nodes = _nodes(s, d)
    return ring.lookup(_keys(s, d), ring.build(nodes), nodes.where("valid"))


@_query("""SELECT c.c_custkey, c.c_name AS key, coalesce(x.node, (SELECT arg_min(node, pos) FROM sv)) AS node
  FROM (SELECT *, sha256(c_name) AS h FROM customer) c ASOF LEFT JOIN sv x ON c.h <= x.pos""".replace("sv", "(SELECT node, sha256(node || '-' || replica) AS pos FROM vn)"))
def ring_lookup_sha256(s, d):
    """The same ring with another hash."""
    return ring.lookup(_keys(s, d), ring.build(_nodes(s, d), ring.sha256), hash_=ring.sha256)


@_query("""SELECT node, count(*) AS vnodes FROM (SELECT node, unnest(range(n_replicas)) AS r FROM (
  SELECT node, n_replicas FROM rn WHERE node NOT IN ('n5', 'n7', 'n8') UNION ALL SELECT * FROM (VALUES ('n7', 9), ('extra', 2)) t(node, n_replicas))) GROUP BY node""")
def ring_add_remove(s, d):
    """A node goes, one comes and one is replaced with more replicas."""
    new = s.sql("SELECT * FROM VALUES ('n7', 9L, true), ('extra', 2L, true) t(node, n_replicas, valid)")
    nodes = ring.add(ring.remove(_nodes(s, d), s.sql("SELECT 'n5' AS node UNION SELECT 'n8'")), new)
    return ring.build(nodes).groupBy("node").agg(F.count("*").alias("vnodes"))


@_query("""SELECT own.c_custkey, own.key, (SELECT arg_min(v.node, k) FROM range(3) t(k) JOIN vn v ON v.i = (own.i + k) % (SELECT count(*) FROM vn) WHERE v.valid) AS node FROM own""")
def ring_lookup_tolerance(s, d):
    nodes = _nodes(s, d)
    return ring.lookup_tolerant(_keys(s, d), ring.build(nodes), nodes.where("valid"), 2)


@_query("SELECT node, count(*) AS n_keys FROM own JOIN vn USING (i) GROUP BY node")
def ring_load_by_node(s, d):
    return ring.lookup(_keys(s, d), ring.build(_nodes(s, d))).groupBy("node").agg(F.count("*").alias("n_keys"))


@_query("""SELECT own.c_custkey, vn.node AS before, n.node AS after FROM own JOIN vn USING (i) JOIN
  (SELECT ck.c_custkey, coalesce(x.node, (SELECT arg_min(node, pos) FROM vn WHERE node <> 'n5')) AS node FROM ck ASOF LEFT JOIN (SELECT * FROM vn WHERE node <> 'n5') x ON ck.h <= x.pos) n
  ON n.c_custkey = own.c_custkey WHERE vn.node <> n.node""")
def ring_rebalance_moves(s, d):
    nodes, keys = _nodes(s, d), _keys(s, d)
    before = ring.lookup(keys, ring.build(nodes)).withColumnRenamed("node", "before")
    after = ring.lookup(before, ring.build(nodes.where("node <> 'n5'")))
    return after.where("before <> node").select("c_custkey", "before", F.col("node").alias("after"))


_PEERS = "SELECT s_name AS addr, md5('7' || s_name) AS h FROM supplier WHERE s_suppkey % 4 <> 0"


def _round(s, d, live: str = "s_suppkey % 4 <> 0", dead: str = "s_suppkey % 4 = 0"):
    addr = lambda where: _table(s, d, "supplier").where(where).select(F.col("s_name").alias("addr"))
    return peers.select(addr("true"), addr(live), addr(dead), _table(s, d, "region").select(F.col("r_name").alias("addr")), 7)


@_query(f"SELECT addr FROM ({_PEERS}) ORDER BY h, addr LIMIT 3")
def peers_select(s, d):
    return _round(s, d).chosen


@_query("SELECT addr FROM (SELECT s_name AS addr FROM supplier) ORDER BY md5('7' || addr), addr LIMIT 3")
def peers_select_fallback(s, d):
    """While no peer is live, all are candidates."""
    return _round(s, d, live="false").chosen


@_query("""SELECT * FROM (SELECT 'dead' AS kind, s_name AS addr FROM supplier WHERE s_suppkey % 4 <> 0 ORDER BY md5('7dead' || s_name), s_name LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'seed' AS kind, r_name FROM region ORDER BY md5('7seed' || r_name), r_name LIMIT 1)""")
def peers_dead_and_seed(s, d):
    """With most peers dead the chance is one or more, so a dead one and a seed are talked to."""
    got = _round(s, d, live="s_suppkey % 4 = 0", dead="s_suppkey % 4 <> 0")
    kind = lambda x, n: x.select(F.lit(n).alias("kind"), "addr")
    return kind(got.dead, "dead").unionByName(kind(got.seed, "seed"))


@_query("""SELECT count(*) FILTER (s_suppkey % 4 = 0) / (count(*) FILTER (s_suppkey % 4 <> 0) + 1) AS p_dead,
  count(*) FILTER (s_suppkey % 4 <> 0) < (SELECT count(*) FROM region) AS needs_seed FROM supplier""")
def peer_probability(s, d):
    n = _table(s, d, "supplier").agg(F.count(F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 1 END")).alias("dead"), F.count(F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN 1 END")).alias("live"))
    seeds = _table(s, d, "region").agg(F.count("*").alias("seeds"))
    return n.crossJoin(seeds).select((F.col("dead") / (F.col("live") + 1)).alias("p_dead"), (F.col("live") < F.col("seeds")).alias("needs_seed"))


@_query("SELECT r_name AS addr FROM region UNION SELECT n_name FROM nation WHERE n_name <> ''")
def seed_union(s, d):
    return peers.seeds(_table(s, d, "region").select(F.col("r_name").alias("addr")), _table(s, d, "nation").select(F.col("n_name").alias("addr")))
