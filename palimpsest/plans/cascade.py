"""Queries over derived nodes, the word index, incremental state, intents and profiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import cascade as c
from ..operators import intents as i
from ..operators import temporal as t
from ..sources import tables
from ..sources.shared import staged
from . import state, text, upkeep

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: the changed log: in its last sixteenth values change, assertions move to new and old subjects and to another
#: predicate, or go; texts change, or go; one subject is forgotten
_CHANGED = """,
late AS (SELECT max(event_id) * 15 // 16 AS cut FROM events),
assertions2 AS (
  SELECT id, CASE WHEN recorded_seq > cut AND recorded_seq % 20 = 3 THEN subject_id || 'x' WHEN recorded_seq > cut AND recorded_seq % 20 = 13 THEN 'u0' ELSE subject_id END AS subject_id,
         CASE WHEN recorded_seq > cut AND recorded_seq % 20 = 8 THEN 'depends_on' ELSE predicate END AS predicate,
         CASE WHEN recorded_seq > cut AND recorded_seq % 10 = 1 THEN '9' ELSE object_value END AS object_value, recorded_seq, valid_from, valid_to
  FROM assertions, late WHERE NOT (recorded_seq > cut AND recorded_seq % 10 = 5) AND subject_id <> 'u1'),
evidence2 AS (
  SELECT id, CASE WHEN recorded_seq > cut AND recorded_seq % 10 = 7 THEN payload || ' revised' ELSE payload END AS payload, recorded_seq
  FROM evidence, late WHERE NOT (recorded_seq > cut AND recorded_seq % 10 = 9)),
olds AS (SELECT id, subject_id, predicate, object_value FROM assertions), news AS (SELECT id, subject_id, predicate, object_value FROM assertions2),
changed AS (SELECT id FROM (SELECT * FROM olds EXCEPT SELECT * FROM news) UNION SELECT id FROM (SELECT * FROM news EXCEPT SELECT * FROM olds)),
either AS (SELECT id, subject_id, predicate FROM olds UNION SELECT id, subject_id, predicate FROM news),
sides AS (SELECT * FROM either WHERE id IN (SELECT id FROM changed)),
rekeyed AS (SELECT id FROM sides GROUP BY id HAVING count(*) > 1 UNION SELECT id FROM changed WHERE id NOT IN (SELECT id FROM news)),
texts AS (SELECT id FROM (SELECT id, payload FROM evidence EXCEPT SELECT id, payload FROM evidence2) UNION SELECT id FROM (SELECT id, payload FROM evidence2 EXCEPT SELECT id, payload FROM evidence)),
reached AS (SELECT DISTINCT subject_id, predicate FROM bridge JOIN texts ON texts.id = evidence_id JOIN either ON either.id = assertion_id),
stale AS (
  SELECT 'profile:' || subject_id AS node FROM sides WHERE id IN (SELECT id FROM rekeyed) UNION SELECT 'profile:' || subject_id FROM reached
  UNION SELECT 'state:' || subject_id || ':' || predicate FROM sides
  UNION SELECT kind || subject_id || ':' || predicate FROM (SELECT subject_id, predicate FROM sides UNION SELECT * FROM reached), (VALUES ('support:'), ('context:')) k(kind))
"""


def _stores(spark, sf_dir):
    """The log as it is, and changed."""
    cut = tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) * 15 div 16").alias("cut"))
    a, e = tables.assertions(spark, sf_dir), tables.evidence(spark, sf_dir)
    before = {"assertions": a, "bridge": tables.bridge(spark, sf_dir), "evidence": e, "relations": tables.relations(spark, sf_dir)}
    n, late = F.col("recorded_seq"), F.col("recorded_seq") > F.col("cut")
    rows = a.join(F.broadcast(cut)).where(~(late & (n % 10 == 5)) & (F.col("subject_id") != "u1"))  # cut: one row
    rows = rows.withColumn("subject_id", F.when(late & (n % 20 == 3), F.concat("subject_id", F.lit("x"))).when(late & (n % 20 == 13), "u0").otherwise(F.col("subject_id")))
    rows = rows.withColumn("predicate", F.when(late & (n % 20 == 8), "depends_on").otherwise(F.col("predicate")))
    rows = rows.withColumn("object_value", F.when(late & (n % 10 == 1), "9").otherwise(F.col("object_value"))).drop("cut")
    said = e.join(F.broadcast(cut)).where(~(late & (n % 10 == 9)))
    said = said.withColumn("payload", F.when(late & (n % 10 == 7), F.concat("payload", F.lit(" revised"))).otherwise(F.col("payload"))).drop("cut")
    return before, before | {"assertions": rows, "evidence": said}


@query(f"WITH {tables.SQL}{upkeep._EDGES} SELECT node, split_part(node, ':', 1) AS kind, CAST(sum(up) AS BIGINT) AS n_dependencies, CAST(sum(down) AS BIGINT) AS n_dependents FROM (SELECT d AS node, 1 AS up, 0 AS down FROM edges UNION ALL SELECT s, 0, 1 FROM edges) GROUP BY node")
def node_views(spark, sf_dir):
    """What each node depends on and what depends on it."""
    return c.node_views(upkeep._edges(spark, sf_dir))


@query(f"""WITH {tables.SQL}, h AS (SELECT max(event_id) * 7 // 8 AS half FROM events),
keys AS (SELECT subject_id || ':' || predicate AS key, max(recorded_seq) <= max(half) AS silent FROM assertions, h GROUP BY ALL)
SELECT 'support:' || key AS node, NOT silent AS refused FROM keys UNION ALL SELECT 'context:' || key, false FROM keys WHERE silent""")
def removal_guard(spark, sf_dir):
    """M4: supports can't go while their contexts stay; contexts of keys that were long silent go with them."""
    a = tables.assertions(spark, sf_dir)
    half = tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) * 7 div 8").alias("half"))
    keys = a.groupBy(*t.KEY).agg(F.max("recorded_seq").alias("last")).join(F.broadcast(half))  # one row
    nodes = keys.select(c.node("support", *t.KEY).alias("node")).unionByName(keys.where("last <= half").select(c.node("context", *t.KEY).alias("node")))
    return c.remove(upkeep._edges(spark, sf_dir), nodes)


@query(f"WITH {tables.SQL}{_CHANGED} SELECT node, split_part(node, ':', 1) AS kind FROM stale")
def stale_nodes(spark, sf_dir):
    """The nodes that a set of changes makes stale, and no other: a new value leaves the profile fresh, a
    new text the state."""
    return c.stale_nodes(*_stores(spark, sf_dir)).select("node", F.split_part("node", F.lit(":"), F.lit(1)).alias("kind"))


def _values_sql(p: str, a: str, e: str) -> str:
    """Relation <p>_nodes (node, digest) of the store with assertions a and evidence e."""
    cells = re.sub(r"\b(vis|hit|judged|val|cell|state)\b", rf"{p}_\1", state._state_sql().replace("FROM assertions", f"FROM {a}"))

    def number(x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"

    return f"""{cells},
{p}_own AS (SELECT DISTINCT x.subject_id, b.evidence_id FROM bridge b JOIN {a} x ON x.id = b.assertion_id),
{p}_words AS (SELECT subject_id, token, count(*) AS tf FROM (SELECT subject_id, unnest({text._lexical('payload')}) AS token FROM {p}_own JOIN {e} x ON x.id = evidence_id) GROUP BY ALL),
{p}_proof AS (
  SELECT subject_id, predicate, count(*) AS n, sum({number("evidence_id || '|' || payload")}) AS digest FROM (
    SELECT DISTINCT j.subject_id, j.predicate, b.evidence_id, x.payload FROM {p}_judged j JOIN bridge b ON b.assertion_id = j.id JOIN {e} x ON x.id = b.evidence_id WHERE NOT is_defeated) GROUP BY ALL),
{p}_nodes AS (
  SELECT 'profile:' || s.subject_id AS node, CAST(coalesce(digest, 0) AS BIGINT) AS digest FROM (SELECT DISTINCT subject_id FROM {a}) s
  LEFT JOIN (SELECT subject_id, sum({number("token || '|' || tf")}) AS digest FROM {p}_words GROUP BY subject_id) w ON w.subject_id = s.subject_id
  UNION ALL SELECT 'state:' || subject_id || ':' || predicate, {number("status || '|' || operative")} FROM {p}_state
  UNION ALL SELECT 'support:' || s.subject_id || ':' || s.predicate, CAST(coalesce(digest, 0) AS BIGINT) FROM {p}_state s LEFT JOIN {p}_proof q ON q.subject_id = s.subject_id AND q.predicate = s.predicate
  UNION ALL SELECT 'context:' || s.subject_id || ':' || s.predicate, {number("s.subject_id || '|' || s.predicate || '|' || status || '|' || operative || '|' || coalesce(n, 0)")} FROM {p}_state s LEFT JOIN {p}_proof q ON q.subject_id = s.subject_id AND q.predicate = s.predicate)
"""


_AFTER = f"{tables.SQL}{_CHANGED}{_values_sql('n', 'assertions2', 'evidence2')}"


def _refreshed(spark, sf_dir):
    before, after = _stores(spark, sf_dir)
    registry = tables.registry(spark)
    stale = staged(c.stale_nodes(before, after), "stale")
    return c.refreshed(c.node_values(before, registry), stale, after, registry), stale, before, after


@query(f"WITH {_AFTER} SELECT node, digest FROM n_nodes JOIN stale USING (node)")
def rebuilt_nodes(spark, sf_dir):
    """Values of the nodes that are rebuilt; fresh ones are not touched."""
    before, after = _stores(spark, sf_dir)
    return c.node_values(after, tables.registry(spark), staged(c.stale_nodes(before, after), "stale"))


@query(f"WITH {_AFTER} SELECT split_part(node, ':', 1) AS kind, count(*) AS n_nodes, count(stale.node) AS n_rebuilt, CAST(0 AS BIGINT) AS n_different FROM n_nodes LEFT JOIN stale USING (node) GROUP BY ALL")
def cascade_parity(spark, sf_dir):
    """Refreshed nodes against a full rebuild, by kind."""
    (nodes, _), stale, _, after = _refreshed(spark, sf_dir)
    full = c.node_values(after, tables.registry(spark)).withColumnRenamed("digest", "full")
    table = full.join(nodes, "node", "full_outer").join(stale.withColumn("rebuilt", F.lit(1)), "node", "left")
    kind = F.split_part("node", F.lit(":"), F.lit(1)).alias("kind")
    return table.groupBy(kind).agg(F.count("full").alias("n_nodes"), F.count("rebuilt").alias("n_rebuilt"), F.count_if(~F.col("full").eqNullSafe(F.col("digest"))).alias("n_different")).where("n_nodes + n_different > 0")


@query(f"""WITH {_AFTER} SELECT node FROM stale WHERE node NOT IN (SELECT node FROM n_nodes) AND (
  node IN (SELECT 'profile:' || subject_id FROM assertions) OR split_part(node, ':', 2) || ':' || split_part(node, ':', 3) IN (SELECT subject_id || ':' || predicate FROM assertions))""")
def retired_nodes(spark, sf_dir):
    """Nodes that lost their ground."""
    (_, retired), _, _, _ = _refreshed(spark, sf_dir)
    return retired


@query(f"WITH {tables.SQL}{_CHANGED} SELECT node, node IN (SELECT node FROM stale) AS blocked FROM (SELECT DISTINCT 'context:' || subject_id || ':' || predicate AS node FROM assertions)")
def readable_contexts(spark, sf_dir):
    """Which contexts must not be read before the refresh."""
    before, after = _stores(spark, sf_dir)
    nodes = before["assertions"].select(c.node("context", *t.KEY).alias("node")).distinct()
    return c.readable(nodes, c.stale_nodes(before, after))


def _index_sql(p: str, a: str, e: str) -> str:
    fragments = "list_filter(regexp_split_to_array(token, '[-_]+'), lambda x: len(x) >= 3)"
    grams = "CASE WHEN len(token) <= 4 THEN [token] ELSE list_transform(range(1, len(token) - 2), lambda i: substring(token, i, 4)) END"
    parts = []
    for name, split in (("token", "[token]"), ("fragment", fragments), ("gram", grams)):
        rows = f"(SELECT DISTINCT subject_id, unnest({split}) AS f FROM {p}_words)"
        parts.append(f"SELECT '{name}' AS structure, subject_id, f AS entry FROM {rows}")
        parts.append(f"SELECT '{name}_predicate', r.subject_id, f || '|' || q.predicate FROM {rows} r JOIN {p}_pred q ON q.subject_id = r.subject_id")
    return f""",
{p}_pred AS (SELECT DISTINCT subject_id, predicate FROM {a}), {p}_own AS (SELECT DISTINCT x.subject_id, b.evidence_id FROM bridge b JOIN {a} x ON x.id = b.assertion_id),
{p}_words AS (SELECT subject_id, token, count(*) AS tf FROM (SELECT subject_id, unnest({text._lexical('payload')}) AS token FROM {p}_own JOIN {e} x ON x.id = evidence_id) GROUP BY ALL),
{p}_index AS (
  {' UNION ALL '.join(parts)}
  UNION ALL SELECT 'profiles', subject_id, token || '|' || tf FROM {p}_words UNION ALL SELECT 'predicates', subject_id, predicate FROM {p}_pred UNION ALL SELECT 'evidence', subject_id, evidence_id FROM {p}_own)
"""


@query(f"""WITH {tables.SQL}{_CHANGED}{_index_sql('o', 'assertions', 'evidence')}{_index_sql('n', 'assertions2', 'evidence2')}
SELECT structure, subject_id, entry, 1 AS change FROM (SELECT * FROM n_index EXCEPT SELECT * FROM o_index)
UNION ALL SELECT structure, subject_id, entry, -1 FROM (SELECT * FROM o_index EXCEPT SELECT * FROM n_index)""")
def index_patch(spark, sf_dir):
    """M1, K3: what a refresh of the affected subjects adds to and takes from nine word structures."""
    before, after = _stores(spark, sf_dir)
    return c.index_patch(before, after, staged(c.affected_subjects(before, after), "subjects"))


@query(f"WITH {tables.SQL}{_CHANGED}{_index_sql('n', 'assertions2', 'evidence2')} SELECT structure, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_different FROM n_index GROUP BY structure")
def index_parity(spark, sf_dir):
    """M3: the patched structures against rebuilt ones."""
    before, after = _stores(spark, sf_dir)
    return c.patched_parity(before, after, staged(c.affected_subjects(before, after), "subjects"))


_CUT = """,
late AS (SELECT max(event_id) * 15 // 16 AS cut FROM events),
fresh AS (SELECT subject_id, predicate, count(*) AS n_new, any_value(id) AS id FROM assertions, late WHERE recorded_seq > cut GROUP BY ALL),
known AS (SELECT DISTINCT subject_id, predicate FROM assertions, late WHERE recorded_seq <= cut)
"""


def _incremental(spark, sf_dir):
    a, rel, registry = tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir), tables.registry(spark)
    cut = tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) * 15 div 16").alias("cut"))
    table = staged(a.join(F.broadcast(cut)).withColumn("late", F.col("recorded_seq") > F.col("cut")).drop("cut"), "assertions")  # cut: one row
    old, new = table.where("not late").drop("late"), table.where("late").drop("late")
    kept = staged(t.reconcile(old, rel, registry).withColumn("version", F.lit(1)), "state")
    return t.incremental(kept, old, new, rel, registry)


@query(f"""WITH {tables.SQL}{state._state_sql()}{_CUT}
SELECT subject_id, predicate, status, operative, CASE WHEN k.subject_id IS NULL THEN 1 ELSE 2 END AS version
FROM state s JOIN fresh f USING (subject_id, predicate) LEFT JOIN known k USING (subject_id, predicate)""".replace("k.subject_id IS NULL", "NOT EXISTS (SELECT 1 FROM known k2 WHERE k2.subject_id = s.subject_id AND k2.predicate = s.predicate)").replace(" LEFT JOIN known k USING (subject_id, predicate)", ""))
def incremental_state(spark, sf_dir):
    """State of the keys that the log's last sixteenth touches, by short paths where they suffice."""
    return t.flat(_incremental(spark, sf_dir).drop("path")).withColumn("version", F.col("version").cast("int"))


@query(f"""WITH {tables.SQL}{state._state_sql('recorded_seq <= (SELECT max(event_id) * 15 // 16 FROM events)')}{_CUT},
defeats AS (SELECT DISTINCT x.subject_id, x.predicate, x.id AS source_id, y.id AS target_id FROM relations r JOIN assertions x ON x.id = r.source_assertion_id JOIN assertions y ON y.id = r.target_assertion_id AND y.subject_id = x.subject_id AND y.predicate = x.predicate
  WHERE relation IN ('corrects', 'supersedes')),
act AS (SELECT subject_id, predicate, count(*) AS n_active FROM judged WHERE NOT is_defeated GROUP BY ALL),
hits AS (SELECT d.subject_id, d.predicate, count(*) AS n_defeats, count(*) FILTER (d.target_id IN (SELECT id FROM judged WHERE NOT is_defeated)) AS n_hit FROM defeats d JOIN assertions s ON s.id = d.source_id, late WHERE s.recorded_seq > cut GROUP BY ALL),
paths AS (
  SELECT f.predicate, CASE WHEN n_new > 1 THEN 'fallback' WHEN s.status IS NULL THEN 'new'
    WHEN cardinality = 'multi' AND coalesce(n_defeats, 0) = 0 AND s.status = 'resolved' THEN 'appended'
    WHEN coalesce(n_active, 0) > 0 AND coalesce(n_hit, 0) = n_active THEN 'replaced'
    WHEN s.status = 'resolved' AND coalesce(n_defeats, 0) = 0 AND s.operative = a.object_value THEN 'same'
    WHEN s.status = 'resolved' AND coalesce(n_defeats, 0) = 0 AND cardinality = 'single' THEN 'conflict' ELSE 'fallback' END AS path
  FROM fresh f JOIN assertions a ON a.id = f.id JOIN registry g ON g.predicate = f.predicate
  LEFT JOIN state s ON s.subject_id = f.subject_id AND s.predicate = f.predicate LEFT JOIN act ON act.subject_id = f.subject_id AND act.predicate = f.predicate
  LEFT JOIN hits h ON h.subject_id = f.subject_id AND h.predicate = f.predicate)
SELECT predicate, path, count(*) AS n FROM paths GROUP BY ALL""")
def incremental_paths(spark, sf_dir):
    """How many keys took which path, and how many fell back."""
    return _incremental(spark, sf_dir).groupBy("predicate", "path").agg(F.count("*").alias("n"))


_ROUTED = state._QUESTIONS + state._state_sql() + """,
qvis AS (SELECT q.query_id, a.* FROM q JOIN assertions a USING (subject_id, predicate) WHERE (q.valid_time IS NOT NULL OR q.known_by IS NOT NULL)
  AND (valid_time IS NULL OR (valid_from <= valid_time AND (valid_to IS NULL OR valid_time <= valid_to))) AND (known_by IS NULL OR recorded_seq <= known_by)),
qhit AS (SELECT DISTINCT s.query_id, g.id FROM qvis s JOIN relations r ON r.source_assertion_id = s.id AND r.relation IN ('corrects', 'supersedes') JOIN qvis g ON g.id = r.target_assertion_id AND g.query_id = s.query_id),
qval AS (SELECT v.query_id, v.predicate, v.object_value, min(CASE WHEN h.id IS NULL THEN v.recorded_seq END) AS seen, count(*) FILTER (h.id IS NULL) AS live FROM qvis v LEFT JOIN qhit h ON h.query_id = v.query_id AND h.id = v.id GROUP BY ALL),
qcell AS (SELECT query_id, predicate, coalesce(string_agg(object_value, ',' ORDER BY seen) FILTER (live > 0), '') AS vals, count(*) FILTER (live > 0) AS n_values FROM qval GROUP BY ALL),
qstate AS (SELECT query_id, CASE WHEN n_values = 0 THEN 'unknown' WHEN cardinality = 'multi' OR n_values = 1 THEN 'resolved' ELSE 'contested' END AS status,
  CASE WHEN n_values > 0 AND (cardinality = 'multi' OR n_values = 1) THEN vals ELSE '' END AS operative FROM qcell JOIN registry USING (predicate)),
truth AS (
  SELECT q.query_id, CASE WHEN valid_time IS NULL AND known_by IS NULL THEN 'kept' ELSE 'on_demand' END AS route,
         CASE WHEN valid_time IS NULL AND known_by IS NULL THEN coalesce(s.status, 'unknown') ELSE coalesce(z.status, 'unknown') END AS status,
         CASE WHEN valid_time IS NULL AND known_by IS NULL THEN coalesce(s.operative, '') ELSE coalesce(z.operative, '') END AS operative
  FROM q LEFT JOIN state s ON s.subject_id = q.subject_id AND s.predicate = q.predicate LEFT JOIN qstate z ON z.query_id = q.query_id)
"""


def _routed(spark, sf_dir, questions):
    """(answers, the state that was kept for them)."""
    a, rel, registry = tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir), tables.registry(spark)
    kept = staged(t.reconcile(a, rel, registry), "state")
    return t.flat(t.routed_answers(questions, kept, a, rel, registry)), kept


@query(f"WITH {tables.SQL}{_ROUTED} SELECT query_id, route, status, operative FROM truth")
def routed_answers(spark, sf_dir):
    """Current questions from kept state, as-of ones on demand."""
    return _routed(spark, sf_dir, state._questions(spark, sf_dir))[0]


@query(f"""WITH {tables.SQL}{_ROUTED},
recent AS (SELECT q.query_id, 'resolved' AS status, arg_max(a.object_value, a.recorded_seq) AS operative FROM q JOIN assertions a USING (subject_id, predicate) GROUP BY q.query_id)
SELECT 'state' AS architecture, count(*) AS n, count(*) AS exact FROM truth
UNION ALL SELECT 'current_only', count(*), count(*) FILTER (t.status = coalesce(s.status, 'unknown') AND t.operative = coalesce(s.operative, '')) FROM truth t JOIN q USING (query_id) LEFT JOIN state s ON s.subject_id = q.subject_id AND s.predicate = q.predicate
UNION ALL SELECT 'recency', count(*), count(*) FILTER (t.status = r.status AND t.operative = r.operative) FROM truth t LEFT JOIN recent r ON r.query_id = t.query_id""")
def architecture_scores(spark, sf_dir):
    """Three ways to answer the same questions: with as-of state, with current state only, by recency."""
    a = tables.assertions(spark, sf_dir)
    questions = staged(state._questions(spark, sf_dir), "questions")
    answers, kept = _routed(spark, sf_dir, questions)
    truth = staged(answers.select("query_id", "status", F.col("operative").alias("value")), "truth")
    kept = t.flat(kept)

    def current(asked):
        return asked.join(kept, t.KEY, "left").select("query_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("operative", F.lit("")).alias("value"))

    def recent(asked):
        return asked.join(t.recency_answer(a), t.KEY).select("query_id", "status", "value")

    return t.judged_architectures({"state": lambda asked: truth, "current_only": current, "recency": recent}, questions, truth)


@query(f"""WITH {tables.SQL}{state._state_sql()},
parts AS (SELECT j.subject_id, j.predicate, j.id, j.recorded_seq, j.object_value, CASE WHEN is_defeated THEN 'historical' WHEN status = 'contested' THEN 'competing' ELSE 'supporting' END AS role FROM judged j JOIN state USING (subject_id, predicate)),
header AS (
  SELECT subject_id, predicate, 1 AS section, 1 AS place, 'ENTITY: ' || subject_id AS line FROM state UNION ALL SELECT subject_id, predicate, 1, 2, 'PROPERTY: ' || predicate FROM state
  UNION ALL SELECT subject_id, predicate, 1, 3, 'CURRENT STATUS: ' || status FROM state UNION ALL SELECT subject_id, predicate, 1, 4, 'CURRENT VALUE: [''' || replace(operative, ',', ''', ''') || ''']' FROM state WHERE operative <> '')
SELECT * FROM header
UNION ALL SELECT subject_id, predicate, 2, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY recorded_seq, id), '- ' || id || ': ''' || object_value || '''' FROM parts WHERE role = 'competing'
UNION ALL SELECT subject_id, predicate, 3, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY recorded_seq, id), '- seq=' || recorded_seq || ' ' || id || ': ''' || object_value || '''' FROM parts
UNION ALL SELECT p.subject_id, p.predicate, 4, row_number() OVER (PARTITION BY p.subject_id, p.predicate ORDER BY p.recorded_seq, p.id, e.id), '- ' || e.id || ': ' || e.payload FROM parts p JOIN bridge b ON b.assertion_id = p.id JOIN evidence e ON e.id = b.evidence_id""")
def context_lines(spark, sf_dir):
    """Header, competing assertions, history and evidence of every key, line by line."""
    a, b, e = (f(spark, sf_dir) for f in (tables.assertions, tables.bridge, tables.evidence))
    rel, registry = tables.relations(spark, sf_dir), tables.registry(spark)
    return t.context_lines(t.reconcile(a, rel, registry), t.support(a, rel, registry), a, b, e)


_INTENTS = """,
intents AS (
  SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'evidence' ELSE 'assertion' END AS target, CASE event_id % 3 WHEN 0 THEN 'e' || event_id ELSE 'a' || event_id END AS id,
         CASE event_id % 3 WHEN 1 THEN 'u' || ((user_id + 1) % (SELECT max(user_id) + 1 FROM events)) WHEN 2 THEN 'u' || user_id END AS subject_id,
         CASE event_id % 3 WHEN 1 THEN (SELECT predicate FROM assertions a WHERE a.id = 'a' || event_id) WHEN 2 THEN 'depends_on' END AS predicate
  FROM events),
""".replace("(SELECT predicate FROM assertions a WHERE a.id = 'a' || event_id)", "CASE event_type WHEN 'signup' THEN 'lives_in' WHEN 'view' THEN 'works_at' WHEN 'click' THEN 'depends_on' WHEN 'purchase' THEN 'deadline' WHEN 'error' THEN 'project_status' END") + """
read_keys AS (
  SELECT seq, a.subject_id || '|' || a.predicate AS read_key FROM intents i JOIN bridge b ON b.evidence_id = i.id JOIN assertions a ON a.id = b.assertion_id WHERE target = 'evidence'
  UNION SELECT seq, a.subject_id || '|' || a.predicate FROM intents i JOIN assertions a ON a.id = i.id WHERE target = 'assertion'
  UNION SELECT seq, subject_id || '|' || predicate FROM intents WHERE target = 'assertion' AND subject_id IS NOT NULL AND predicate IS NOT NULL)
"""


def _intents(spark, sf_dir):
    """One intent an event: its text, a move to the next user, or a change of its predicate."""
    e = tables.table(spark, sf_dir, "events")
    users = e.agg((F.max("user_id") + 1).alias("users"))
    k = F.col("event_id") % 3
    number = F.col("event_id").cast("string")
    return e.join(F.broadcast(users)).select(  # users: one row
        F.col("event_id").alias("seq"),
        F.when(k == 0, "evidence").otherwise("assertion").alias("target"),
        F.when(k == 0, F.concat(F.lit("e"), number)).otherwise(F.concat(F.lit("a"), number)).alias("id"),
        F.when(k == 1, F.concat(F.lit("u"), ((F.col("user_id") + 1) % F.col("users")).cast("string"))).when(k == 2, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("subject_id"),
        F.when(k == 1, tables._predicate(F.col("event_type"))).when(k == 2, "depends_on").alias("predicate"),
    )


def _read_keys(spark, sf_dir):
    return i.read_keys(_intents(spark, sf_dir), tables.assertions(spark, sf_dir), tables.bridge(spark, sf_dir))


@query(f"WITH {tables.SQL}{_INTENTS} SELECT seq, read_key FROM read_keys")
def intent_read_keys(spark, sf_dir):
    """The keys that each intent may change."""
    return _read_keys(spark, sf_dir)


@query(f"""WITH {tables.SQL}{_INTENTS}, phases AS (SELECT seq, ['prepared', 'canonical_applied', 'invalidated', 'rebuilding', 'done'][1 + seq % 5] AS phase FROM intents, (SELECT max(seq) * 31 // 32 AS cut FROM intents) WHERE seq > cut),
protected AS (SELECT DISTINCT read_key FROM read_keys JOIN phases USING (seq) WHERE phase IN ('canonical_applied', 'invalidated', 'rebuilding'))
SELECT o_orderkey AS query_id, r AS read_key, r IN (SELECT read_key FROM protected) AS blocked FROM (
  SELECT o_orderkey, 'u' || (o_custkey % (SELECT max(user_id) + 1 FROM events)) || '|' || ['lives_in','works_at','depends_on','deadline','project_status'][1 + o_orderkey % 5] AS r FROM orders)""")
def snapshot_gate(spark, sf_dir):
    """Readers are held only where an intent in flight protects the very key that they read."""
    asked = state._questions(spark, sf_dir).select("query_id", F.concat_ws("|", *t.KEY).alias("read_key"))
    names = F.array(*[F.lit(x) for x in ("prepared", "canonical_applied", "invalidated", "rebuilding", "done")])
    seqs = _intents(spark, sf_dir).select("seq")
    cut = seqs.agg(F.expr("max(seq) * 31 div 32").alias("cut"))
    phases = seqs.join(F.broadcast(cut)).where("seq > cut").select("seq", F.get(names, (F.col("seq") % 5).cast("int")).alias("phase"))  # cut: one row
    return i.gate(asked, _read_keys(spark, sf_dir), phases)


_MOVED = f"""{tables.SQL}{_INTENTS},
moved AS (SELECT a.id, coalesce(i.subject_id, a.subject_id) AS subject_id, coalesce(i.predicate, a.predicate) AS predicate, a.recorded_seq FROM assertions a LEFT JOIN (SELECT * FROM intents WHERE target = 'assertion') i ON i.id = a.id)"""


def _moved(spark, sf_dir):
    return i.moved(tables.assertions(spark, sf_dir), _intents(spark, sf_dir).where("target = 'assertion'"))


@query(f"WITH {_MOVED} SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id, count(*) AS n FROM moved GROUP BY ALL")
def moved_heads(spark, sf_dir):
    """Heads once all moves of subject and predicate are drained."""
    return _moved(spark, sf_dir).groupBy(*t.KEY).agg(F.max_by("id", F.struct("recorded_seq", "id")).alias("id"), F.count("*").alias("n"))


@query(f"""WITH {_MOVED},
later AS (
  SELECT seq, m.subject_id || '|' || m.predicate AS read_key FROM intents i JOIN bridge b ON b.evidence_id = i.id JOIN moved m ON m.id = b.assertion_id WHERE target = 'evidence'
  UNION SELECT seq, m.subject_id || '|' || m.predicate FROM intents i JOIN moved m ON m.id = i.id WHERE target = 'assertion'
  UNION SELECT seq, subject_id || '|' || predicate FROM intents WHERE target = 'assertion' AND subject_id IS NOT NULL AND predicate IS NOT NULL)
SELECT seq, count(r.read_key) AS n_admitted, count(l.read_key) AS n_promoted, bool_or(r.read_key IS NULL OR l.read_key IS NULL) AS changed
FROM read_keys r FULL JOIN later l USING (seq, read_key) GROUP BY seq""")
def revalidated_keys(spark, sf_dir):
    """Read keys found again at promotion, after the moves before."""
    later = i.read_keys(_intents(spark, sf_dir), _moved(spark, sf_dir), tables.bridge(spark, sf_dir))
    return i.revalidated(_read_keys(spark, sf_dir), later)


@query(f"""WITH {tables.SQL}{_CHANGED}, touched AS (SELECT DISTINCT subject_id, predicate FROM sides),
have AS (SELECT DISTINCT subject_id, predicate FROM assertions), want AS (SELECT DISTINCT subject_id, predicate FROM assertions2)
SELECT t.subject_id, t.predicate, CASE WHEN h.subject_id IS NULL THEN 'insert' ELSE 'delete' END AS change
FROM touched t LEFT JOIN have h ON h.subject_id = t.subject_id AND h.predicate = t.predicate LEFT JOIN want w ON w.subject_id = t.subject_id AND w.predicate = t.predicate
WHERE (h.subject_id IS NULL) <> (w.subject_id IS NULL)""")
def membership_sync(spark, sf_dir):
    """Which membership rows a set of changes inserts and deletes."""
    before, after = (s["assertions"].select("id", *t.KEY, "object_value") for s in _stores(spark, sf_dir))
    touched = before.exceptAll(after).unionByName(after.exceptAll(before)).select(*t.KEY).distinct()
    put, drop = i.synced(before, staged(touched, "touched"), after)
    return put.withColumn("change", F.lit("insert")).unionByName(drop.withColumn("change", F.lit("delete")))


@query(f"""WITH {tables.SQL}, heads AS (SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id FROM assertions GROUP BY ALL),
want AS (SELECT s.subject_id, g.predicate FROM (SELECT DISTINCT subject_id FROM assertions) s, registry g),
proof AS (SELECT h.subject_id, count(DISTINCT b.evidence_id) AS n_evidence FROM heads h JOIN bridge b ON b.assertion_id = h.id JOIN evidence e ON e.id = b.evidence_id GROUP BY h.subject_id)
SELECT w.subject_id, count(h.id) AS n_facets, coalesce(string_agg(CASE WHEN h.id IS NULL THEN w.predicate END, ',' ORDER BY w.predicate), '') AS missing, coalesce(max(n_evidence), 0) AS n_evidence
FROM want w LEFT JOIN heads h ON h.subject_id = w.subject_id AND h.predicate = w.predicate LEFT JOIN proof p ON p.subject_id = w.subject_id GROUP BY w.subject_id""")
def composed_profiles(spark, sf_dir):
    """Every facet of each subject, with those that it lacks by name."""
    a, registry = tables.assertions(spark, sf_dir), tables.registry(spark)
    heads = t.current_heads(a).select(*t.KEY, "id")
    want = a.select("subject_id").distinct().select("subject_id", F.explode(F.array(*[F.lit(p) for p, _ in sorted(tables.PREDICATES.values())])).alias("predicate")).join(F.broadcast(registry), "predicate")
    proof = heads.withColumnRenamed("id", "assertion_id").join(tables.bridge(spark, sf_dir), "assertion_id").join(tables.evidence(spark, sf_dir).select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
    proof = proof.groupBy("subject_id").agg(F.countDistinct("evidence_id").alias("n_evidence"))
    lacking = F.array_join(F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.col("predicate")))), ",")  # at most one entry a predicate
    out = want.join(heads, t.KEY, "left").groupBy("subject_id").agg(F.count("id").alias("n_facets"), lacking.alias("missing"))
    return out.join(proof, "subject_id", "left").select("subject_id", "n_facets", "missing", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"))


@query(f"""WITH {_AFTER} SELECT split_part(node, ':', 1) AS kind, count(*) AS n_stale, CAST(sum(n_sources) AS BIGINT) AS reads FROM (
  SELECT st.node, count(e.s) AS n_sources FROM stale st JOIN n_nodes USING (node) LEFT JOIN (
    SELECT DISTINCT 'profile:' || subject_id AS d, id AS s FROM assertions2 UNION ALL SELECT DISTINCT 'state:' || subject_id || ':' || predicate, id FROM assertions2
    UNION ALL SELECT DISTINCT 'support:' || subject_id || ':' || predicate, evidence_id FROM assertions2 JOIN bridge ON assertion_id = id
    UNION ALL SELECT DISTINCT 'context:' || subject_id || ':' || predicate, 'support' FROM assertions2) e ON e.d = st.node GROUP BY st.node) GROUP BY kind""")
def refresh_work(spark, sf_dir):
    """What a refresh of the stale nodes reads, by kind: assertions, evidence, supports."""
    before, after = _stores(spark, sf_dir)
    a, key = after["assertions"], ["subject_id", "predicate"]
    met = a.join(after["bridge"].withColumnRenamed("assertion_id", "id"), "id")
    sources = [a.select(c.node("profile", "subject_id").alias("node"), "id"), a.select(c.node("state", *key).alias("node"), "id"), met.select(c.node("support", *key).alias("node"), F.col("evidence_id").alias("id")), a.select(c.node("context", *key).alias("node"), F.lit("support").alias("id"))]
    table = sources[0].distinct()
    for more in sources[1:]:
        table = table.unionByName(more.distinct())
    per = table.join(c.stale_nodes(before, after), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    return per.groupBy(F.split_part("node", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n_stale"), F.sum("n").alias("reads"))
