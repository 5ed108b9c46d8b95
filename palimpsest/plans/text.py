"""Queries over texts: postings, tf-idf, planning, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as r
from ..operators import temporal as t
from ..sources import tables
from ..sources.shared import staged
from . import state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOKENS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9_-]+'), lambda x: lower(x))"


@query(f"""SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_occurrences
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def token_postings(spark, sf_dir):
    """Document and term frequency of every token of the documents."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    posted = r.postings(docs, tx.tokens(F.col("text")), "doc_id")
    return posted.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_occurrences"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in tx.STOP) + ")"
_SYNONYMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in tx.CONCEPTS.items()) + "}"


def _lexical(text: str) -> str:
    return f"list_filter({_TOKENS.format(text)}, lambda x: x NOT IN {_STOPS})"


def _concepts(text: str) -> str:
    kept = f"list_filter({_TOKENS.format(text)}, lambda x: NOT regexp_matches(x, '{tx.ENTITY}'))"
    return f"list_transform({kept}, lambda x: coalesce({_SYNONYMS}[x], x))"


def _channel_sql(name: str, docs: str, asked: str) -> str:
    """Relations <name>_d (id, term, weight) and <name>_q (query_id, term, q_weight) out of docs (id, w) and asked
    (query_id, w): words and pairs of neighbours."""

    def terms(table: str, key: str) -> str:
        return f"""SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(w) AS term FROM {table}
    UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {table} WHERE len(w) > 1) GROUP BY ALL"""

    return f"""
{name}_p AS ({terms(docs, 'id')}),
{name}_i AS (SELECT term, ln((1 + (SELECT count(*) FROM {docs})) / (1 + count(*))) + 1 AS idf FROM {name}_p GROUP BY term),
{name}_d AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, tf * idf AS raw FROM {name}_p JOIN {name}_i USING (term))),
{name}_q AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS q_weight FROM (
  SELECT query_id, term, tf * idf AS raw FROM ({terms(asked, 'query_id')}) JOIN {name}_i USING (term)))"""


_BENCH = f"""
l_docs AS (SELECT conv_id * 1000 + turn AS id, {_TOKENS.format('text')} AS w FROM conversations),
l_asked AS (SELECT item_id AS query_id, {_TOKENS.format('text')} AS w FROM benchmark),
c_docs AS (SELECT conv_id * 1000 + turn AS id, {_concepts('text')} AS w FROM conversations),
c_asked AS (SELECT item_id AS query_id, {_concepts('text')} AS w FROM benchmark),
{_channel_sql('l', 'l_docs', 'l_asked')}, {_channel_sql('c', 'c_docs', 'c_asked')},
ls AS (SELECT query_id, id, round(sum(q_weight * weight), 6) AS score FROM l_q JOIN l_d USING (term) GROUP BY ALL HAVING round(sum(q_weight * weight), 6) > 0),
cs AS (SELECT query_id, id, round(sum(q_weight * weight), 6) AS score FROM c_q JOIN c_d USING (term) GROUP BY ALL HAVING round(sum(q_weight * weight), 6) > 0)
"""


def _corpus(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _words(text):
    return tx.terms(tx.tokens(text))


def _ideas(text):
    return tx.terms(tx.concepts(text))


def _scores(spark, sf_dir, **channels):
    docs = _corpus(spark, sf_dir)
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    split = {name: (words(F.col("text")), words(F.col("text"))) for name, words in channels.items()}
    return r.channel_scores(docs, asked, split, docs.agg(F.count("*").alias("n")))


def _five(scores: str, extra: str = "") -> str:
    return f"""SELECT query_id, id, score{extra}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scores}) WHERE rank <= 5"""


@query(f"WITH {_BENCH} {_five('ls')}")
def tfidf_cosine_topk(spark, sf_dir):
    """The five turns nearest to each benchmark item by tf-idf of words and word pairs."""
    return r.top(_scores(spark, sf_dir, score=_words), 5)


@query(f"WITH {_BENCH} {_five('cs')}")
def semantic_topk(spark, sf_dir):
    """The same in the concept channel."""
    return r.top(_scores(spark, sf_dir, score=_ideas), 5)


_HYBRID = """(
  SELECT query_id, id, round(0.55 * coalesce(cs.score, 0) + 0.45 * coalesce(ls.score, 0), 6) AS score,
         concat_ws('+', CASE WHEN cs.score IS NOT NULL THEN 'concept' END, CASE WHEN ls.score IS NOT NULL THEN 'lexical' END) AS channels
  FROM cs FULL JOIN ls USING (query_id, id))"""


@query(f"WITH {_BENCH} {_five(_HYBRID, ', channels')}")
def hybrid_topk(spark, sf_dir):
    """Concept and lexical channels together."""
    return r.top(r.hybrid_scores(_scores(spark, sf_dir, c=_ideas, l=_words)), 5)


@query(f"WITH {_BENCH} SELECT 'semantic_only' AS mode, * FROM ({_five('cs')}) UNION ALL SELECT 'lexical_only', * FROM ({_five('ls')}) UNION ALL SELECT 'hybrid_text', * FROM ({_five(_HYBRID)})")
def search_modes(spark, sf_dir):
    """What each text mode returns."""
    both = _scores(spark, sf_dir, c=_ideas, l=_words)
    scores = {"both": both, **{name: both.where(F.col(c).isNotNull()).select("query_id", "id", F.col(c).alias("score")) for name, c in (("concept", "c"), ("lexical", "l"))}}
    parts = [r.search(mode, scores, 5).select(F.lit(mode).alias("mode"), "query_id", "id", "score", "rank") for mode in r.MODES[:3]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PROPERTIES = ("deadline", "status", "employer", "residence", "dependency", "size", "due date", "status amount")
_ASKED = f""",
reach AS (SELECT max(user_id) + 1 AS users, max(event_id) + 1 AS seqs, max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) + 1 AS days FROM events),
asked AS (
  SELECT o_orderkey AS query_id,
         CASE (o_orderkey // 8) % 4 WHEN 0 THEN 'What is the current ' || p || ' of u' || s || '?'
                             WHEN 1 THEN 'What was the ' || p || ' of u' || s || ' as of day ' || (o_orderkey % days) || '?'
                             WHEN 2 THEN 'Why do we think the ' || p || ' of u' || s || ' is right, seq ' || (o_orderkey * 31 % seqs) || '?'
                             ELSE 'Was the ' || p || ' of u' || s || ' corrected?' END AS question
  FROM (SELECT o_orderkey, o_custkey % users AS s, [{', '.join(f"'{p}'" for p in _PROPERTIES)}][1 + o_orderkey % 8] AS p, days, seqs FROM orders, reach))
"""


def _asked(spark, sf_dir):
    """One plain-language question an order, about any user, day and sequence number that the log holds."""
    e = tables.table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    reach = e.agg((F.max("user_id") + 1).alias("users"), (F.max("event_id") + 1).alias("seqs"), (F.max(day) + 1).alias("days"))
    k = F.col("o_orderkey")
    p = F.get(F.array(*[F.lit(x) for x in _PROPERTIES]), (k % 8).cast("int"))
    s = F.concat(F.lit("u"), (F.col("o_custkey") % F.col("users")).cast("string"))
    kind = F.expr("(o_orderkey div 8) % 4")
    text = (
        F.when(kind == 0, F.concat(F.lit("What is the current "), p, F.lit(" of "), s, F.lit("?")))
        .when(kind == 1, F.concat(F.lit("What was the "), p, F.lit(" of "), s, F.lit(" as of day "), (k % F.col("days")).cast("string"), F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Why do we think the "), p, F.lit(" of "), s, F.lit(" is right, seq "), (k * 31 % F.col("seqs")).cast("string"), F.lit("?")))
        .otherwise(F.concat(F.lit("Was the "), p, F.lit(" of "), s, F.lit(" corrected?")))
    )
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(F.broadcast(reach)).select(k.alias("query_id"), text.alias("question"))  # reach: one row



def _cue(name: str, cues: tuple[str, ...]) -> str:
    return "WHEN " + " OR ".join(f"contains(lower(question), '{c}')" for c in cues) + f" THEN '{name}'"


_CUES = " ".join(_cue(name, cues) for name, cues in tx.INTENTS)
_PLAN = f""",
phrases AS (SELECT * FROM (VALUES {', '.join(f"('{name}', '{x}')" for name, xs in tx.PHRASES.items() for x in xs)}) v(predicate, phrase)),
longest AS (SELECT query_id, predicate, max(len(phrase)) AS n FROM asked JOIN phrases ON contains(lower(question), phrase) GROUP BY ALL),
named AS (
  SELECT query_id, CASE WHEN count(*) = 1 THEN max(predicate) END AS predicate
  FROM (SELECT *, max(n) OVER (PARTITION BY query_id) AS most FROM longest) WHERE n = most GROUP BY query_id),
parsed AS (
  SELECT asked.query_id, question, CASE {_CUES} ELSE 'current' END AS intent, predicate,
    CAST(nullif(regexp_extract(question, 'day ([0-9]+)', 1), '') AS BIGINT) AS valid_time,
    CAST(nullif(regexp_extract(question, 'seq ([0-9]+)', 1), '') AS BIGINT) AS known_by
  FROM asked LEFT JOIN named ON named.query_id = asked.query_id)
"""


def _read(asked):
    q = F.col("question")
    parts = [tx.intent(q).alias("intent"), tx.predicate(q).alias("predicate"), tx.valid_time(q).alias("valid_time"), tx.recorded_seq(q).alias("known_by")]
    return asked.select("query_id", "question", *parts)


def _parsed(spark, sf_dir):
    """Questions and their parts, read once: staged, so that filters on a part don't repeat its expression."""
    return staged(_read(_asked(spark, sf_dir)), "parsed")


@query(f"WITH {tables.SQL}{_ASKED}{_PLAN} SELECT query_id, intent, predicate, valid_time, known_by FROM parsed")
def question_plan(spark, sf_dir):
    """Intent, predicate (none where two phrases are equally long) and times of each question."""
    return _read(_asked(spark, sf_dir)).drop("question")


_PROFILES = f""",
own AS (SELECT DISTINCT a.subject_id, b.evidence_id FROM bridge b JOIN assertions a ON a.id = b.assertion_id),
profiles AS (
  SELECT subject_id, token, count(*) AS tf FROM (
    SELECT subject_id, unnest({_lexical('payload')}) AS token FROM own JOIN evidence e ON e.id = own.evidence_id) GROUP BY ALL),
n_subjects AS (SELECT count(DISTINCT subject_id) AS n FROM profiles),
idf AS (SELECT token, ln((1 + n) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM profiles, n_subjects GROUP BY token, n)
"""


def _profiles(spark, sf_dir):
    return r.subject_profiles(tables.evidence(spark, sf_dir), tables.bridge(spark, sf_dir), tables.assertions(spark, sf_dir))


@query(f"WITH {tables.SQL}{_PROFILES} SELECT token, df, round(idf, 6) AS idf FROM idf")
def profile_idf(spark, sf_dir):
    """P5, P10: idf of every profile token."""
    p = _profiles(spark, sf_dir)
    n = p.agg(F.countDistinct("subject_id").alias("n"))
    df = p.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    return df.select("token", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


_SUBJECT = f""",
facts AS (SELECT DISTINCT b.evidence_id, a.subject_id, a.predicate FROM bridge b JOIN assertions a ON a.id = b.assertion_id),
carried AS (SELECT DISTINCT p.predicate, s.subject_id FROM facts p JOIN facts s USING (evidence_id)),
asked_tokens AS (SELECT query_id, predicate, token, count(*) AS times FROM (SELECT query_id, predicate, unnest({_lexical('question')}) AS token FROM parsed) GROUP BY ALL),
scores AS (
  SELECT query_id, subject_id, sum(times * idf * (1 + ln(tf))) AS score FROM asked_tokens a JOIN profiles USING (token) JOIN idf USING (token)
  WHERE a.predicate IS NULL OR EXISTS (SELECT 1 FROM carried c WHERE c.predicate = a.predicate AND c.subject_id = profiles.subject_id) GROUP BY ALL),
placed AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, subject_id) AS place FROM scores),
agg AS (
  SELECT query_id, max(best) AS best, count(*) FILTER (best - score <= 1e-9) AS n_tied, max(CASE WHEN place = 2 THEN score END) AS second, max(CASE WHEN place = 1 THEN subject_id END) AS one
  FROM placed GROUP BY query_id),
plans AS (
  SELECT p.query_id, p.question, p.intent, p.predicate, p.valid_time, p.known_by, CASE WHEN n_tied = 1 THEN one END AS subject_id, coalesce(n_tied, 0) AS n_tied,
         CASE WHEN n_tied = 1 THEN round(least(1.0, greatest(0.0, (best - coalesce(second, 0.0)) / best)), 6) ELSE 0.0 END AS confidence
  FROM parsed p LEFT JOIN agg USING (query_id))
"""


def _subjects(spark, sf_dir, parsed):
    p = staged(_profiles(spark, sf_dir), "profiles")
    allowed = staged(r.subject_predicates(tables.bridge(spark, sf_dir), tables.assertions(spark, sf_dir)), "carried")
    return r.plan_subjects(parsed, p, allowed, p.agg(F.countDistinct("subject_id").alias("n")))


def _plans(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed.join(t.large(_subjects(spark, sf_dir, parsed)), "query_id")


@query(f"WITH {tables.SQL}{_ASKED}{_PLAN}{_PROFILES}{_SUBJECT} SELECT query_id, subject_id, n_tied, confidence FROM plans")
def question_subject(spark, sf_dir):
    """The subject that each question names, or none if tied; stop words don't count, and with a predicate only
    subjects that carry it do."""
    return _subjects(spark, sf_dir, _parsed(spark, sf_dir))


@query(f"""WITH {tables.SQL}{_ASKED}{_PLAN}{_PROFILES}{_SUBJECT}
SELECT query_id, intent, predicate, valid_time, known_by, subject_id, confidence, subject_id IS NOT NULL AND predicate IS NOT NULL AS resolved FROM plans""")
def question_plans(spark, sf_dir):
    """The whole plan of each question, and whether it is resolved."""
    resolved = (F.col("subject_id").isNotNull() & F.col("predicate").isNotNull()).alias("resolved")
    return _plans(spark, sf_dir).select("query_id", "intent", "predicate", "valid_time", "known_by", "subject_id", "confidence", resolved)


_ALIASES = f""",
names AS (SELECT 'c' || c_custkey AS subject_id, 'client-' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 10) || ' ' || c_mktsegment AS payload FROM customer),
profiles AS (SELECT subject_id, token, count(*) AS tf FROM (SELECT subject_id, unnest({_lexical('payload')}) AS token FROM names) GROUP BY ALL),
n_subjects AS (SELECT count(DISTINCT subject_id) AS n FROM profiles),
asked AS (
  SELECT o_orderkey AS query_id, 'Which orders has client-' || CASE WHEN o_orderkey % 3 = 0 THEN h WHEN o_orderkey % 3 = 1 THEN substr(h, 1, 9) ELSE substr(h, 2, 7) || '-' || substr(h, 9, 2) END || ' in building' AS question
  FROM (SELECT o_orderkey, substr(md5(CAST(o_custkey AS VARCHAR)), 1, 10) AS h FROM orders)),
fragments AS (SELECT DISTINCT token, f, subject_id FROM (SELECT token, subject_id, unnest(list_filter(regexp_split_to_array(token, '[-_]+'), lambda x: len(x) >= 3)) AS f FROM profiles)),
grams AS (SELECT DISTINCT token, f, subject_id FROM (SELECT token, subject_id, unnest(CASE WHEN len(token) <= 4 THEN [token] ELSE list_transform(range(1, len(token) - 2), lambda i: substring(token, i, 4)) END) AS f FROM profiles)),
postings AS (
  SELECT DISTINCT 'token' AS kind, token AS f, subject_id FROM profiles UNION ALL SELECT DISTINCT 'fragment', f, subject_id FROM fragments UNION ALL SELECT DISTINCT 'gram', f, subject_id FROM grams),
sizes AS (SELECT kind, f, count(*) AS size FROM postings GROUP BY ALL),
asked_tokens AS (SELECT query_id, unnest({_lexical('question')}) AS token FROM asked),
tokens AS (SELECT query_id, token, size FROM asked_tokens LEFT JOIN (SELECT f, size FROM sizes WHERE kind = 'token') s ON s.f = token),
missing AS (SELECT query_id, token FROM tokens WHERE size IS NULL),
parts AS (
  SELECT query_id, 'fragment' AS kind, unnest(list_distinct(list_filter(regexp_split_to_array(token, '[-_]+'), lambda x: len(x) >= 3))) AS f, 3.0 AS weight FROM missing
  UNION ALL SELECT query_id, 'gram', unnest(list_distinct(CASE WHEN len(token) <= 4 THEN [token] ELSE list_transform(range(1, len(token) - 2), lambda i: substring(token, i, 4)) END)), 1.0 FROM missing),
lookups AS (
  SELECT query_id, 'token' AS kind, token AS f, size, CAST(4 * (ln((1 + n) / (1 + size)) + 1) AS DOUBLE) AS weight FROM tokens, n_subjects WHERE size IS NOT NULL
  UNION ALL SELECT query_id, p.kind, p.f, size, CAST(weight AS DOUBLE) FROM parts p JOIN sizes s ON s.kind = p.kind AND s.f = p.f),
ledger AS (SELECT query_id, CAST(sum(CASE WHEN size <= 128 THEN size ELSE 0 END) AS BIGINT) AS entries_examined, count(*) FILTER (size > 128) AS broad_skipped FROM lookups GROUP BY query_id),
met AS (SELECT query_id, subject_id, round(sum(weight), 6) AS first FROM lookups l JOIN postings p ON p.kind = l.kind AND p.f = l.f WHERE size <= 128 GROUP BY ALL),
best AS (SELECT query_id, subject_id, first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, subject_id) AS place FROM met) WHERE place <= 32),
exact AS (
  SELECT a.query_id, p.subject_id, sum((ln((1 + n) / (1 + size)) + 1) * (1 + ln(tf))) AS exact FROM asked_tokens a JOIN best b ON b.query_id = a.query_id
  JOIN profiles p ON p.token = a.token AND p.subject_id = b.subject_id JOIN (SELECT f, size FROM sizes WHERE kind = 'token') s ON s.f = a.token, n_subjects GROUP BY ALL),
scored AS (SELECT b.query_id, b.subject_id, round(coalesce(exact, 0.0) + 0.1 * first, 6) AS score FROM best b LEFT JOIN exact e ON e.query_id = b.query_id AND e.subject_id = b.subject_id),
placed AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, subject_id) AS place FROM scored),
agg AS (
  SELECT query_id, max(top) AS top, count(*) AS n_candidates, count(*) FILTER (top - score <= 1e-9) AS n_tied, max(CASE WHEN place = 2 THEN score END) AS second, max(CASE WHEN place = 1 THEN subject_id END) AS one
  FROM placed GROUP BY query_id)
"""


@query(f"""WITH {_ALIASES.lstrip(',')}
SELECT q.query_id, CASE WHEN n_tied = 1 THEN one END AS subject_id,
       CASE WHEN n_tied = 1 THEN round(least(1.0, greatest(0.0, (top - coalesce(second, 0.0)) / top)), 6) ELSE 0.0 END AS confidence,
       coalesce(n_tied, 0) AS n_tied, coalesce(n_candidates, 0) AS n_candidates, coalesce(entries_examined, 0) AS entries_examined, coalesce(broad_skipped, 0) AS broad_skipped
FROM asked q LEFT JOIN ledger l ON l.query_id = q.query_id LEFT JOIN agg a ON a.query_id = q.query_id""")
def noisy_alias(spark, sf_dir):
    """Whom a question means that names a client with letters lost, with the ledger of postings."""
    c = tables.table(spark, sf_dir, "customer")
    code = lambda column: F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 10)
    names = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject_id"), F.concat(F.lit("client-"), code("c_custkey"), F.lit(" "), "c_mktsegment").alias("payload"))
    profiles = names.select("subject_id", F.explode(tx.lexical(F.col("payload"))).alias("token")).groupBy("subject_id", "token").agg(F.count("*").alias("tf"))
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), code("o_custkey").alias("h"))
    k, h = F.col("query_id") % 3, F.col("h")
    typed = F.when(k == 0, h).when(k == 1, F.substring(h, 1, 9)).otherwise(F.concat(F.substring(h, 2, 7), F.lit("-"), F.substring(h, 9, 2)))
    asked = o.select("query_id", F.concat(F.lit("Which orders has client-"), typed, F.lit(" in building")).alias("question"))
    return r.noisy_subjects(asked, profiles, profiles.agg(F.countDistinct("subject_id").alias("n")))


_DOCS = """,
doc_facts AS (SELECT b.evidence_id, a.subject_id, a.predicate, a.valid_from, a.valid_to FROM bridge b JOIN assertions a ON a.id = b.assertion_id)
"""


def _docs(spark, sf_dir):
    return r.assembled(tables.evidence(spark, sf_dir), tables.bridge(spark, sf_dir), tables.assertions(spark, sf_dir))


@query(f"""WITH {tables.SQL}{_DOCS}
SELECT e.id, e.recorded_seq, coalesce(string_agg(DISTINCT f.subject_id, ',' ORDER BY f.subject_id), '') AS subjects,
       coalesce(string_agg(DISTINCT f.predicate, ',' ORDER BY f.predicate), '') AS predicates, count(DISTINCT CASE WHEN f.evidence_id IS NOT NULL THEN {{'a': valid_from, 'b': valid_to}} END) AS n_intervals
FROM evidence e LEFT JOIN doc_facts f ON f.evidence_id = e.id GROUP BY e.id, e.recorded_seq""")
def assembled_docs(spark, sf_dir):
    """Evidence with the subjects, predicates and intervals of its assertions, also without any."""
    return _docs(spark, sf_dir).select("id", "recorded_seq", *[F.array_join(c, ",").alias(c) for c in ("subjects", "predicates")], F.size("intervals").cast("long").alias("n_intervals"))


@query(f"""WITH {tables.SQL}{_DOCS}
SELECT 'subject' AS kind, subject_id AS address, count(DISTINCT evidence_id) AS n FROM doc_facts GROUP BY subject_id
UNION ALL SELECT 'predicate', predicate, count(DISTINCT evidence_id) FROM doc_facts GROUP BY predicate
UNION ALL SELECT 'token', token, count(DISTINCT id) FROM (SELECT id, unnest({_TOKENS.format('payload')}) AS token FROM evidence) GROUP BY token""")
def address_postings(spark, sf_dir):
    """T4: how much evidence each subject, predicate and token leads to."""
    docs = _docs(spark, sf_dir)
    said = tables.evidence(spark, sf_dir).select(F.explode(F.array_distinct(tx.tokens(F.col("payload")))).alias("address"))
    parts = [docs.select(F.explode(c).alias("address")).withColumn("kind", F.lit(kind)) for kind, c in (("subject", "subjects"), ("predicate", "predicates"))]
    every = parts[0].unionByName(parts[1]).unionByName(said.withColumn("kind", F.lit("token")))
    return every.groupBy("kind", "address").agg(F.count("*").alias("n"))


@query(f"""WITH {tables.SQL}{_ASKED}{_PLAN}{_PROFILES}{_SUBJECT}
SELECT query_id, concat_ws(' ', subject_id, replace(predicate, '_', ' '),
  CASE intent WHEN 'current' THEN 'current latest' WHEN 'historical' THEN 'historical previous' WHEN 'relation_classification' THEN 'correction changed transition previous current'
              WHEN 'provenance' THEN 'source evidence support' END, 'day ' || valid_time) AS text FROM plans""")
def query_texts(spark, sf_dir):
    """What is asked of the text channels for each structured question."""
    return r.query_text(_plans(spark, sf_dir))


_ALLOWED = """,
resolved AS (SELECT * FROM plans WHERE subject_id IS NOT NULL AND predicate IS NOT NULL),
allowed AS (
  SELECT p.query_id, e.id, e.recorded_seq FROM resolved p
  JOIN (SELECT DISTINCT subject_id, evidence_id FROM doc_facts) s ON s.subject_id = p.subject_id
  JOIN evidence e ON e.id = s.evidence_id AND (p.known_by IS NULL OR e.recorded_seq <= p.known_by)
  WHERE EXISTS (SELECT 1 FROM doc_facts f WHERE f.evidence_id = e.id AND f.predicate = p.predicate)
    AND (p.valid_time IS NULL OR EXISTS (SELECT 1 FROM doc_facts f WHERE f.evidence_id = e.id AND f.valid_from <= p.valid_time AND (f.valid_to IS NULL OR p.valid_time <= f.valid_to))))
"""
_TO_ALLOWED = f"{tables.SQL}{_ASKED}{_PLAN}{_PROFILES}{_SUBJECT}{_DOCS}{_ALLOWED}"


_RESOLVED = "subject_id is not null and predicate is not null"


def _resolved(spark, sf_dir):
    return staged(_plans(spark, sf_dir).where(_RESOLVED), "plans")


@query(f"WITH {_TO_ALLOWED} SELECT query_id, count(*) AS n_allowed, max(recorded_seq) AS newest FROM allowed GROUP BY query_id")
def hard_filter(spark, sf_dir):
    """What each resolved question's constraints let through (uncorrelated parts)."""
    return r.hard_filter(_resolved(spark, sf_dir), _docs(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_allowed"), F.max("recorded_seq").alias("newest"))


def _ranked_sql(budget: int) -> str:
    return f"""{_TO_ALLOWED},
l_docs AS (SELECT id, {_TOKENS.format('payload')} AS w FROM evidence), l_asked AS (SELECT query_id, {_TOKENS.format('question')} AS w FROM resolved),
c_docs AS (SELECT id, {_concepts('payload')} AS w FROM evidence), c_asked AS (SELECT query_id, {_concepts('question')} AS w FROM resolved),
{_channel_sql('l', 'l_docs', 'l_asked')}, {_channel_sql('c', 'c_docs', 'c_asked')},
ls AS (SELECT a.query_id, a.id, round(sum(q_weight * weight), 6) AS score FROM allowed a JOIN l_d d ON d.id = a.id JOIN l_q q ON q.query_id = a.query_id AND q.term = d.term GROUP BY ALL HAVING round(sum(q_weight * weight), 6) > 0),
cs AS (SELECT a.query_id, a.id, round(sum(q_weight * weight), 6) AS score FROM allowed a JOIN c_d d ON d.id = a.id JOIN c_q q ON q.query_id = a.query_id AND q.term = d.term GROUP BY ALL HAVING round(sum(q_weight * weight), 6) > 0),
hits AS (SELECT query_id, id, round(0.55 * coalesce(cs.score, 0) + 0.45 * coalesce(ls.score, 0), 6) AS score FROM cs FULL JOIN ls USING (query_id, id)),
ranked AS (
  SELECT a.query_id, a.id, coalesce(h.score, 0.0) AS score, row_number() OVER (
    PARTITION BY a.query_id ORDER BY CASE WHEN h.score IS NULL THEN 1 ELSE 0 END, h.score DESC, a.recorded_seq DESC, a.id) AS rank
  FROM allowed a LEFT JOIN hits h ON h.query_id = a.query_id AND h.id = a.id QUALIFY rank <= {budget})"""


def _searched(spark, sf_dir, plans, budget):
    evidence = tables.evidence(spark, sf_dir)
    said, asked, n = F.col("payload"), F.col("question"), evidence.agg(F.count("*").alias("n"))
    channels = [r.channel(evidence, plans, words(said), words(asked), n) for words in (_ideas, _words)]
    return r.planned_search(plans, _docs(spark, sf_dir), channels, budget)


@query(f"WITH {_ranked_sql(4)} SELECT query_id, id, rank, score FROM ranked")
def planned_search(spark, sf_dir):
    """Four pieces of evidence a resolved question by the hybrid score inside its constraints, then the
    newest allowed ones; questions without a plan abstain."""
    return _searched(spark, sf_dir, _resolved(spark, sf_dir), 4)


_COVERED = """,
own_facts AS (SELECT b.evidence_id AS id, a.id AS assertion_id, a.subject_id, a.predicate, a.object_value FROM bridge b JOIN assertions a ON a.id = b.assertion_id),
found AS (SELECT r.query_id, r.rank, f.assertion_id, f.object_value FROM ranked r JOIN resolved p USING (query_id) JOIN own_facts f ON f.id = r.id AND f.subject_id = p.subject_id AND f.predicate = p.predicate),
firsts AS (SELECT query_id, assertion_id, min(rank) AS rank FROM found GROUP BY ALL),
two_values AS (
  SELECT query_id, min(rank) AS one, max(CASE WHEN place = 2 THEN rank END) AS two FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, object_value) AS place FROM (SELECT query_id, object_value, min(rank) AS rank FROM found GROUP BY ALL)) WHERE place <= 2 GROUP BY query_id),
both_ends AS (
  SELECT s.query_id, min(greatest(s.rank, g.rank)) AS pair_rank FROM firsts s JOIN relations l ON l.source_assertion_id = s.assertion_id AND l.relation IN ('corrects', 'supersedes')
  JOIN firsts g ON g.query_id = s.query_id AND g.assertion_id = l.target_assertion_id GROUP BY s.query_id),
needed AS (
  SELECT p.query_id, CASE WHEN intent = 'relation_classification' THEN pair_rank WHEN st.status = 'contested' THEN two ELSE one END AS needed
  FROM resolved p LEFT JOIN two_values v USING (query_id) LEFT JOIN both_ends b USING (query_id) LEFT JOIN state st ON st.subject_id = p.subject_id AND st.predicate = p.predicate)
"""


def _needed(spark, sf_dir, plans, budget):
    ranked = _searched(spark, sf_dir, plans, budget)
    a, rel = tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir)
    cells = t.reconcile(a, rel, tables.registry(spark))
    return r.coverage_rank(staged(ranked, "ranked"), plans, tables.bridge(spark, sf_dir), a, rel, cells)


@query(f"""WITH {_ranked_sql(4)}{state._state_sql()}{_COVERED}
SELECT p.query_id, coalesce(n.needed <= 4, false) AS covered, p.subject_id IS NULL OR p.predicate IS NULL AS abstained FROM plans p LEFT JOIN needed n USING (query_id)""")
def coverage(spark, sf_dir):
    """Whether four results cover each question; one without a plan abstains and is not covered."""
    plans = staged(_plans(spark, sf_dir), "plans")
    asked = plans.select("query_id", (F.col("subject_id").isNull() | F.col("predicate").isNull()).alias("abstained"))
    return asked.join(t.large(_needed(spark, sf_dir, plans.where(_RESOLVED), 4)), "query_id", "left").select("query_id", F.coalesce(F.col("needed") <= 4, F.lit(False)).alias("covered"), "abstained")


@query(f"""WITH {_ranked_sql(16)}{state._state_sql()}{_COVERED}
SELECT query_id, b AS budget, CAST(log2(b) + 1 AS BIGINT) AS rounds, coalesce(needed <= 16, false) AS covered FROM (
  SELECT *, CAST(CASE WHEN needed <= 1 THEN 1 WHEN needed <= 2 THEN 2 WHEN needed <= 4 THEN 4 WHEN needed <= 8 THEN 8 ELSE 16 END AS BIGINT) AS b FROM needed)""")
def adaptive_budget(spark, sf_dir):
    """The budget, doubled from 1 to 16, at which each resolved question is covered; ranked once."""
    return r.adaptive_budget(_needed(spark, sf_dir, _resolved(spark, sf_dir), 16))


@query(f"""WITH {_ranked_sql(4)}, gold AS (SELECT p.query_id, f.evidence_id AS id FROM resolved p JOIN doc_facts f ON f.subject_id = p.subject_id AND f.predicate = p.predicate GROUP BY ALL)
SELECT p.intent, count(*) AS n, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(CASE WHEN h > 0 THEN 1 ELSE 0 END) AS BIGINT) AS answered, CAST(sum(CASE WHEN h = g THEN 1 ELSE 0 END) AS BIGINT) AS complete
FROM (SELECT g.query_id, count(*) AS g, count(r.id) AS h FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.id = g.id GROUP BY g.query_id) s JOIN resolved p USING (query_id) GROUP BY p.intent""")
def retrieval_scores(spark, sf_dir):
    """How much of the evidence of each question's key its four results hold, and whether all of it."""
    plans = _resolved(spark, sf_dir)
    ranked = _searched(spark, sf_dir, plans, 4)
    own = tables.bridge(spark, sf_dir).join(t.large(tables.assertions(spark, sf_dir).select(F.col("id").alias("assertion_id"), *t.KEY)), "assertion_id").select(*t.KEY, F.col("evidence_id").alias("id")).distinct()
    gold = plans.select("query_id", *t.KEY).join(t.large(own), t.KEY).join(t.large(ranked.select("query_id", "id", "rank")), ["query_id", "id"], "left")
    per = gold.groupBy("query_id").agg(F.count("*").alias("g"), F.count("rank").alias("h")).join(t.large(plans.select("query_id", "intent")), "query_id")
    return per.groupBy("intent").agg(F.count("*").alias("n"), F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("answered"), F.count_if(F.col("h") == F.col("g")).alias("complete"))


@query(f"""SELECT fragment, count(*) AS n FROM (
  SELECT unnest(list_filter(regexp_split_to_array(token, '[-_]+'), lambda x: len(x) >= 3)) AS fragment
  FROM (SELECT DISTINCT unnest({_TOKENS.format('c_name')}) AS token FROM customer)) GROUP BY fragment""")
def fragment_postings(spark, sf_dir):
    """Fragments of name tokens."""
    names = tables.table(spark, sf_dir, "customer").select(F.explode(tx.tokens(F.col("c_name"))).alias("token")).distinct()
    return names.select(F.explode(tx.fragments(F.col("token"))).alias("fragment")).groupBy("fragment").agg(F.count("*").alias("n"))


@query(f"""SELECT gram, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(token) <= 4 THEN [token] ELSE list_transform(range(1, len(token) - 2), lambda i: substring(token, i, 4)) END) AS gram
  FROM (SELECT DISTINCT unnest({_TOKENS.format('c_name')}) AS token FROM customer)) GROUP BY gram""")
def ngram_postings(spark, sf_dir):
    """Character 4-grams of name tokens."""
    names = tables.table(spark, sf_dir, "customer").select(F.explode(tx.tokens(F.col("c_name"))).alias("token")).distinct()
    return names.select(F.explode(tx.grams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_concepts('payload')}) AS word FROM (WITH {tables.SQL} SELECT payload FROM evidence)) GROUP BY word")
def concept_counts(spark, sf_dir):
    """Concepts of what the evidence says: names gone, synonyms replaced."""
    return tables.evidence(spark, sf_dir).select(F.explode(tx.concepts(F.col("payload"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
