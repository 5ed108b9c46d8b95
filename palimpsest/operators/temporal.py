"""State of (subject, predicate) keys from assertions and relations, by valid time and knowledge time.

Two semantics stand side by side. ``reconcile`` is aware of relations: what is corrected or superseded is defeated,
and what remains is resolved, contested or unknown. ``current_heads`` takes the newest assertion of a key, whatever
the relations say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["subject_id", "predicate"]
DEFEATING = ("corrects", "supersedes")


def large(table: DataFrame) -> DataFrame:
    """table, as one side of a join that must sort and merge. Spark takes what comes out of an explode, an aggregate or a
    compressed file for far smaller than it is, and below its limit it would send all of it through the driver."""
    return table.hint("merge")


def active_at(t: Column) -> Column:
    """Closed validity interval; a null bound is open, a null t lets all through."""
    return t.isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (t <= F.col("valid_to"))))


def visible_by(k: Column) -> Column:
    return k.isNull() | (F.col("recorded_seq") <= k)


def visible(assertions: DataFrame, valid_time: Column | None = None, recorded_seq: Column | None = None) -> DataFrame:
    """The assertions in force at valid_time and known by recorded_seq."""
    rows = assertions
    if valid_time is not None:
        rows = rows.where(active_at(valid_time))
    if recorded_seq is not None:
        rows = rows.where(visible_by(recorded_seq))
    return rows


def scoped_relations(rows: DataFrame, relations: DataFrame, question: list[str] | None = None) -> DataFrame:
    """Relations whose two ends are both among rows, in the same key (and question)."""
    question = question or []
    ends = rows.select(*question, *KEY, "id")
    source = ends.withColumnRenamed("id", "source_assertion_id")
    target = ends.withColumnRenamed("id", "target_assertion_id")
    return relations.join(source, "source_assertion_id").join(target, [*question, *KEY, "target_assertion_id"])


def defeated(rows: DataFrame, relations: DataFrame, question: list[str] | None = None) -> DataFrame:
    """Targets of corrects and supersedes. Not transitive: a defeated source still defeats."""
    hits = scoped_relations(rows, relations.where(F.col("relation").isin(*DEFEATING)), question)
    return hits.select(*(question or []), *KEY, F.col("target_assertion_id").alias("id")).distinct()


def judged(rows: DataFrame, relations: DataFrame, question: list[str] | None = None) -> DataFrame:
    """rows with ``is_defeated``."""
    keys = [*(question or []), *KEY, "id"]
    source = rows.select(*keys).withColumnRenamed("id", "source_assertion_id")
    # that the target is among rows too, in the same key, is what the last join finds
    hits = relations.where(F.col("relation").isin(*DEFEATING)).select("source_assertion_id", F.col("target_assertion_id").alias("id")).join(large(source), "source_assertion_id")
    out = hits.select(*keys).distinct().withColumn("is_defeated", F.lit(True))
    return rows.join(large(out), keys, "left").withColumn("is_defeated", F.coalesce("is_defeated", F.lit(False)))


def reconcile(rows: DataFrame, relations: DataFrame, registry: DataFrame, question: list[str] | None = None) -> DataFrame:
    """One row a key (and question): status, operative (distinct values in first-seen order), n_candidates,
    n_historical. rows: visible assertions.

    Multi-valued: all candidates support. Single-valued: resolved if one value is left, contested if several. No
    candidate: unknown, with history. A predicate that the registry lacks: unregistered, without a value. Candidates are first counted by value, so that a key with a large share of all
    rows meets in one task as its distinct values only.
    """
    return reconciled(judged(rows, relations, question), registry, question)


def reconciled(table: DataFrame, registry: DataFrame, question: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """``reconcile`` of rows that are judged already. order: what a key's rows are in order by, (recorded_seq, id) unless
    a place by these is at hand."""
    group = [*(question or []), *KEY]
    seen = F.min(F.when(~F.col("is_defeated"), F.struct("recorded_seq", "id") if order is None else order))
    values = table.groupBy(*group, "object_value").agg(seen.alias("seen"), F.count_if(~F.col("is_defeated")).alias("live"), F.count_if("is_defeated").alias("past"))
    firsts = F.array_sort(F.collect_list(F.when(F.col("live") > 0, F.struct("seen", "object_value"))))
    cells = values.groupBy(*group).agg(firsts.alias("firsts"), F.sum("live").alias("n_candidates"), F.sum("past").alias("n_historical"))
    cells = cells.join(F.broadcast(registry), "predicate", "left")  # a handful of predicates
    cells = cells.withColumn("values", F.transform("firsts", lambda x: x["object_value"]))
    status = F.when(F.col("cardinality").isNull(), "unregistered").when(F.col("n_candidates") == 0, "unknown").when((F.col("cardinality") == "multi") | (F.size("values") == 1), "resolved").otherwise("contested")
    cells = cells.withColumn("status", status)
    operative = F.when(F.col("status") == "resolved", F.col("values")).otherwise(F.array().cast("array<string>"))
    return cells.select(*group, "status", operative.alias("operative"), "n_candidates", "n_historical")


def support(rows: DataFrame, relations: DataFrame, registry: DataFrame, question: list[str] | None = None) -> DataFrame:
    """The assertions of every key with their part in its state: supporting, competing or historical."""
    group = [*(question or []), *KEY]
    state = reconcile(rows, relations, registry, question).select(*group, "status")
    table = judged(rows, relations, question).join(state, group)
    role = F.when(F.col("is_defeated"), "historical").when(F.col("status") == "contested", "competing").otherwise("supporting")
    return table.select(*group, "id", "recorded_seq", role.alias("role"))


def flat(state: DataFrame) -> DataFrame:
    """The arrays of a state as comma-joined text."""
    return state.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in state.dtypes])


def current_heads(assertions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest assertion of each key, by (recorded_seq, id)."""
    keys = keys or KEY
    rest = [c for c in assertions.columns if c not in keys]
    newest = assertions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("recorded_seq", "id")).alias("head"))
    return newest.select(*keys, "head.*")


def relation_label(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """How the newest visible assertion of a key relates to the one before: correction, transition or null; the first
    corrects or supersedes relation between the two in insertion order decides."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("recorded_seq"), F.desc("id"))
    pairs = rows.select(*KEY, "id", F.lead("id").over(order).alias("older"), F.row_number().over(order).alias("at")).where("at = 1")
    named = relations.where(F.col("relation").isin(*DEFEATING)).groupBy("source_assertion_id", "target_assertion_id").agg(F.min_by("relation", "rel_seq").alias("relation"))
    found = pairs.join(named, (pairs.id == named.source_assertion_id) & (pairs.older == named.target_assertion_id), "left")
    return found.select(*KEY, F.col("id").alias("newer"), "older", F.when(F.col("relation") == "corrects", "correction").when(F.col("relation") == "supersedes", "transition").alias("label"))


def answers(state: DataFrame, labels: DataFrame) -> DataFrame:
    """status, value (one value as it is, several comma-joined, none null) and relation of every key."""
    value = F.when(F.size("operative") > 0, F.array_join("operative", ","))
    out = state.select(*KEY, "status", value.alias("value")).join(labels.select(*KEY, "label"), KEY, "left")
    return out.select(*KEY, "status", "value", F.col("label").alias("relation"))


def provenance(parts: DataFrame, bridge: DataFrame) -> DataFrame:
    """The distinct evidence of each key's supporting and competing assertions."""
    used = parts.where("role <> 'historical'").select(*KEY, F.col("id").alias("assertion_id"))
    return used.join(bridge, "assertion_id").select(*KEY, "evidence_id").distinct()


def recency_answer(rows: DataFrame) -> DataFrame:
    """The control: newest visible assertion, always resolved."""
    return current_heads(rows).select(*KEY, F.lit("resolved").alias("status"), F.col("object_value").alias("value"), F.col("id").alias("assertion_id"))


def as_of(questions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Many questions (query_id, subject_id, predicate, valid_time, known_by; null: no filter) in one pass: the
    visible assertions of each, with query_id."""
    met = assertions.join(questions, KEY)
    return met.where(active_at(F.col("valid_time")) & visible_by(F.col("known_by"))).select("query_id", *assertions.columns)


def inspection(state: DataFrame) -> DataFrame:
    """subject_id, predicate, context: one short text a key, with its status, its values if any, and how many candidates
    and past assertions stand behind it."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("ENTITY: "), "subject_id"),
        F.concat(F.lit("PROPERTY: "), "predicate"),
        F.concat(F.lit("CURRENT STATUS: "), "status"),
        F.when(F.size("operative") > 0, F.concat(F.lit("CURRENT VALUE: "), F.array_join("operative", ", "))),
        F.concat(F.lit("CANDIDATES: "), F.col("n_candidates").cast("string"), F.lit(" HISTORICAL: "), F.col("n_historical").cast("string")),
    )
    return state.select(*KEY, lines.alias("context"))


def context_lines(state: DataFrame, parts: DataFrame, assertions: DataFrame, bridge: DataFrame, evidence: DataFrame) -> DataFrame:
    """subject_id, predicate, section, place, line: what is shown for a key, line by line, so that a key with a long
    history is never gathered in one place. parts: as ``support`` gives them.

    Sections in order: 1 header (entity, property, status, values), 2 competing assertions (only of contested keys),
    3 the history of assertions, 4 evidence with its text. Places within a section are by sequence and id.
    """
    quoted = F.transform("operative", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    header = F.array(
        F.concat(F.lit("ENTITY: "), "subject_id"),
        F.concat(F.lit("PROPERTY: "), "predicate"),
        F.concat(F.lit("CURRENT STATUS: "), "status"),
        F.when(F.size("operative") > 0, F.concat(F.lit("CURRENT VALUE: ["), F.array_join(quoted, ", "), F.lit("]"))),
    )
    top = state.select(*KEY, F.lit(1).alias("section"), F.posexplode(header).alias("place", "line")).where("line is not null")
    top = top.select(*KEY, "section", (F.col("place") + 1).cast("long").alias("place"), "line")
    value = assertions.select("id", F.concat(F.lit("'"), "object_value", F.lit("'")).alias("value"))
    said = parts.join(value, "id")
    order = Window.partitionBy(*KEY).orderBy("recorded_seq", "id")

    def section(number: int, rows: DataFrame, line: Column, by: Window = order) -> DataFrame:
        return rows.select(*KEY, F.lit(number).alias("section"), F.row_number().over(by).cast("long").alias("place"), line.alias("line"))

    competing = section(2, said.where("role = 'competing'"), F.concat(F.lit("- "), "id", F.lit(": "), "value"))
    history = section(3, said, F.concat(F.lit("- seq="), F.col("recorded_seq").cast("string"), F.lit(" "), "id", F.lit(": "), "value"))
    proof = parts.select(*KEY, "recorded_seq", "id").join(bridge.withColumnRenamed("assertion_id", "id"), "id")
    proof = proof.join(evidence.select(F.col("id").alias("evidence_id"), "payload"), "evidence_id")
    proof = section(4, proof, F.concat(F.lit("- "), "evidence_id", F.lit(": "), "payload"), Window.partitionBy(*KEY).orderBy("recorded_seq", "id", "evidence_id"))
    return top.unionByName(competing).unionByName(history).unionByName(proof)


#: which sections an intent shows
SECTIONS = {"current": (1, 2), "historical": (1, 2, 3), "historical_belief": (1, 2, 3), "relation_classification": (1, 2, 3), "provenance": (1, 2, 3, 4)}


def incremental(state: DataFrame, old: DataFrame, new: DataFrame, relations: DataFrame, registry: DataFrame) -> DataFrame:
    """subject_id, predicate, status, operative, version, path of every key with a new assertion.

    state: of the old assertions, with operative and version. A key with one new assertion takes a short path where
    that gives what full reconciliation would: new key; appended (many values, nothing defeated); replaced (it defeats
    all that is active); same (repeats the one value); conflict (another value, nothing defeated). All other keys fall
    back to reconciling their own assertions again. Keys without a new assertion are not read.
    """
    from .maintenance import touched_only

    touched = new.groupBy(*KEY).agg(F.count("*").alias("n_new"), F.any_value("id").alias("new_id"), F.any_value("object_value").alias("new_value"))
    defeats = scoped_relations(old.unionByName(new), relations.where(F.col("relation").isin(*DEFEATING))).select(*KEY, "source_assertion_id", "target_assertion_id").distinct()
    mine = defeats.join(new.select(F.col("id").alias("source_assertion_id")), "source_assertion_id", "left_semi")
    active = judged(touched_only(old, touched, KEY), relations).where("not is_defeated")
    hit = mine.select(*KEY, F.col("target_assertion_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    counts = active.join(hit, [*KEY, "id"], "left").groupBy(*KEY).agg(F.count("*").alias("n_active"), F.count("hit").alias("n_hit"))
    hits = mine.groupBy(*KEY).agg(F.count("*").alias("n_defeats"))
    back = defeats.join(new.select(F.col("id").alias("target_assertion_id")), "target_assertion_id", "left_semi").groupBy(*KEY).agg(F.count("*").alias("n_back"))
    table = touched.join(state.select(*KEY, F.col("status").alias("was"), F.col("operative").alias("had"), "version"), KEY, "left").join(F.broadcast(registry), "predicate", "left")
    table = table.join(counts, KEY, "left").join(hits, KEY, "left").join(back, KEY, "left").na.fill(0, ["n_active", "n_hit", "n_defeats", "n_back"])
    alone = (F.col("n_new") == 1) & (F.col("n_back") == 0) & F.col("cardinality").isNotNull()
    value = F.array("new_value")
    path = (
        F.when(~alone, "fallback")
        .when(F.col("was").isNull(), "new")
        .when((F.col("cardinality") == "multi") & (F.col("n_defeats") == 0) & (F.col("was") == "resolved"), "appended")
        .when((F.col("n_active") > 0) & (F.col("n_hit") == F.col("n_active")), "replaced")
        .when((F.col("was") == "resolved") & (F.col("n_defeats") == 0) & (F.col("had") == value), "same")
        .when((F.col("was") == "resolved") & (F.col("n_defeats") == 0) & (F.col("cardinality") == "single"), "conflict")
        .otherwise("fallback")
    )
    table = table.withColumn("path", path).withColumn("version", F.coalesce(F.col("version") + 1, F.lit(1)).cast("long"))
    short = table.where("path <> 'fallback'")
    appended = F.when(F.array_contains("had", F.col("new_value")), F.col("had")).otherwise(F.concat("had", value))
    operative = F.when(F.col("path") == "appended", appended).when(F.col("path") == "conflict", F.array().cast("array<string>")).otherwise(value)
    short = short.select(*KEY, F.when(F.col("path") == "conflict", "contested").otherwise("resolved").alias("status"), operative.alias("operative"), "version", "path")
    slow = table.where("path = 'fallback'").select(*KEY, "version", "path")
    again = reconcile(touched_only(old.unionByName(new), slow, KEY), relations, registry).select(*KEY, "status", "operative")
    return short.unionByName(slow.join(again, KEY).select(*short.columns))


def reconcile_as_of(questions: DataFrame, assertions: DataFrame, relations: DataFrame, registry: DataFrame) -> DataFrame:
    """``reconcile`` of what each question (``as_of``) sees, for many questions.

    Every assertion carries its place in its key and when its defeaters are in force; a question's row tells by itself
    whether one of them is visible too. So relations are joined once with assertions, not with each question's rows,
    and these, which met by key, are reconciled where they met.
    """
    by = F.struct("valid_from", "valid_to", "recorded_seq")
    source = assertions.select(*KEY, F.col("id").alias("source_assertion_id"), by.alias("by"))
    hits = relations.where(F.col("relation").isin(*DEFEATING)).select("source_assertion_id", F.col("target_assertion_id").alias("id")).join(source, "source_assertion_id")
    hits = hits.groupBy(*KEY, "id").agg(F.collect_set("by").alias("defeaters"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("recorded_seq", "id"))
    rows = assertions.select(*KEY, "id", "object_value", "recorded_seq", "valid_from", "valid_to").join(hits, [*KEY, "id"], "left").withColumn("place", place)
    met = rows.join(questions.select("query_id", *KEY, "valid_time", "known_by"), KEY).where(active_at(F.col("valid_time")) & visible_by(F.col("known_by")))

    def in_force(x: Column) -> Column:
        t, k = F.col("valid_time"), F.col("known_by")
        active = (x["valid_from"].isNull() | (x["valid_from"] <= t)) & (x["valid_to"].isNull() | (t <= x["valid_to"]))
        return (t.isNull() | active) & (k.isNull() | (x["recorded_seq"] <= k))

    met = met.select("query_id", *KEY, "object_value", "place", F.coalesce(F.exists("defeaters", in_force), F.lit(False)).alias("is_defeated"))
    return reconciled(met, registry, ["query_id"], F.col("place"))


def routed_answers(questions: DataFrame, state: DataFrame, assertions: DataFrame, relations: DataFrame, registry: DataFrame) -> DataFrame:
    """query_id, route, status, operative. Questions (query_id, subject_id, predicate, valid_time, known_by) without an
    as-of read the kept state, those with one are reconciled on demand; a key that neither knows is unknown."""
    kept = questions.where("valid_time is null and known_by is null").join(state.select(*KEY, "status", "operative"), KEY, "left")
    late = questions.where("valid_time is not null or known_by is not null")
    found = reconcile_as_of(late, assertions, relations, registry)
    late = late.join(found.select("query_id", "status", "operative"), "query_id", "left")
    none = F.array().cast("array<string>")

    def shown(rows: DataFrame, route: str) -> DataFrame:
        return rows.select("query_id", F.lit(route).alias("route"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("operative", none).alias("operative"))

    return shown(kept, "kept").unionByName(shown(late, "on_demand"))


def judged_architectures(answers: dict[str, object], questions: DataFrame, truth: DataFrame) -> DataFrame:
    """architecture, n, exact: any number of ways to answer, each a callable questions -> (query_id, status, value),
    against the truth of the same form."""
    out = None
    for name, answer in answers.items():
        got = answer(questions).select("query_id", F.col("status").alias("s"), F.col("value").alias("v"))
        hit = F.col("status").eqNullSafe(F.col("s")) & F.col("value").eqNullSafe(F.col("v"))
        rows = truth.join(got, "query_id", "left").agg(F.count("*").alias("n"), F.count_if(hit).alias("exact")).select(F.lit(name).alias("architecture"), "n", "exact")
        out = rows if out is None else out.unionByName(rows)
    return out
