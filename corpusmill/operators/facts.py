"""Facts from evidence text, conflicts between them, and what is computed from them.

Evidence is rows of (block_id, source_file, text). A fact is a row of (entity, field,
value, amount, status, ...): one table in long form, so that every rule below is a
filter, a window or a join over all entities and fields at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small

NAME = r"\bProject\s+([A-Z][A-Z0-9_-]*)\b"
OWNER = r"managed by ([A-Za-z0-9_ ]+)"
RENAME = r"(?i)Project\s+([A-Za-z0-9_\-]+)\s+was\s+renamed\s+to\s+Project\s+([A-Za-z0-9_\-]+)"
REASSIGNED = r"(?i)reassigned\s+from\s+([^,]+)\s+to\s+([^,\.]+)"


def document_dates(evidence: DataFrame) -> DataFrame:
    """(source_file, date): the block date of the greatest year, the first block of those."""
    dated = evidence.select("source_file", "block_id", T.date_parts(F.col("text")).alias("date")).where(F.col("date.y") != -1)
    return dated.groupBy("source_file").agg(F.max_by("date", F.struct(F.col("date.y"), -F.col("block_id"))).alias("date"))


def renames(evidence: DataFrame) -> DataFrame:
    """(old, new), upper case; the last block that renames a name decides."""
    told = evidence.where(F.contains(F.lower("text"), F.lit("renamed")))  # the pattern runs where its word is
    found = told.select("block_id", F.upper(F.regexp_extract("text", RENAME, 1)).alias("old"), F.upper(F.regexp_extract("text", RENAME, 2)).alias("new"))
    return found.where("old <> ''").groupBy("old").agg(F.max_by("new", "block_id").alias("new"))


def extract(evidence: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """Facts of all lines. A line without a project speaks of the block's projects, unless
    the file is noise; header lines say nothing; reassigned owners are obsolete. A file's
    date is an aggregate that is joined back: no task holds a file's blocks. Amounts,
    states and owners have a projection each, so that a pattern runs once a line."""
    dates = document_dates(evidence).select(F.col("source_file").alias("_file"), "date")
    undated = F.struct(*[F.lit(-1).alias(x) for x in "ymd"])
    base = evidence.join(dates, F.col("source_file").eqNullSafe(F.col("_file")), "left").select(
        "block_id", "source_file", "text", F.coalesce("date", undated).alias("date"), F.array_distinct(T.matches(F.col("text"), NAME, 1)).alias("of_block"),
    )
    lines = base.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).drop("text").where(~T.is_header_line(F.col("line")))
    of_line = F.array_distinct(T.matches(F.col("line"), NAME, 1))
    targets = F.when(F.size(of_line) > 0, of_line).when(~T.is_noise_path(F.col("source_file")), F.col("of_block"))
    rows = lines.withColumn("entity", F.explode(targets))
    if renamed is not None:
        rows = rows.join(broadcast_if_small(renamed), rows["entity"] == renamed["old"], "left").withColumn("entity", F.coalesce("new", "entity")).drop("old", "new")
    line, nothing = F.col("line"), F.lit(None).cast("bigint")
    left, came = (F.when(F.contains(F.lower(line), F.lit("reassigned")), F.trim(T.found(line, REASSIGNED, i))) for i in (1, 2))  # patterns run where their word is
    manager = F.when(F.contains(line, F.lit("managed by")), F.trim(T.found(line, OWNER, 1)))
    rows = rows.withColumns({"budget": T.budget_string(line), "status": T.line_status(line), "left": left, "came": came, "manager": manager})
    rows = rows.withColumn("amount", T.normalized_budget(F.col("budget")))
    budget, amount, status, left, came = map(F.col, ("budget", "amount", "status", "left", "came"))
    owner = F.coalesce("manager", "left")
    fact = lambda n, field, value, number, state: F.when(value.isNotNull(), F.struct(F.lit(n).alias("n"), F.lit(field).alias("field"), value.alias("value"), number.alias("amount"), state.alias("status")))
    facts = F.array_compact(F.array(
        fact(0, "owner", owner, nothing, F.when(owner == left, "obsolete").otherwise(status)),
        fact(1, "owner", came, nothing, F.lit("active")),
        fact(2, "budget", F.when(amount.isNotNull(), budget), amount, status),
        fact(3, "deadline", T.found(line, r"\b\d{1,2}\s+[a-zA-Z]+\s+\d{4}\b"), nothing, status),
    ))
    path = F.col("source_file")
    return rows.select("block_id", "source_file", "date", "line_no", "entity", F.explode(facts).alias("f")).select(
        "entity", "f.field", "f.value", "f.amount", "f.status", "source_file", "block_id", "date",
        (F.col("line_no") * 4 + F.col("f.n")).alias("seq"), T.is_amendment(path).alias("is_amendment"), T.is_base(path).alias("is_base"), T.is_noise_path(path).alias("is_noise"),
    )


def resolved(facts: DataFrame, by: list[str]) -> DataFrame:
    """One fact per group, or none: clean files before noise (even if then nothing active
    is left), active ones, the latest date, amendments, the first."""
    return _best(facts, by).where("best IS NOT NULL").select(*by, *[F.col("best")[c].alias(c) for c in facts.columns if c not in by])


def _best(facts: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, best): the resolved fact as a struct, or null. An aggregate that is partly
    done before the shuffle, however many facts a group has."""
    order = F.struct("date", "is_amendment", -F.col("block_id"), -F.col("seq"))
    fact = F.struct(*[c for c in facts.columns if c not in by])
    first = lambda noise: F.max_by(fact, F.when((F.col("status") == "active") & (F.col("is_noise") == noise), order))
    rows = facts.groupBy(*by).agg(F.max(~F.col("is_noise")).alias("clean"), first(False).alias("of_clean"), first(True).alias("of_noise"))
    return rows.select(*by, F.when(F.col("clean"), F.col("of_clean")).otherwise(F.col("of_noise")).alias("best"))


def known_amounts(facts: DataFrame, field: str) -> DataFrame:
    """(entity, amount) of every entity that any fact names, in one pass: the resolved
    amount of ``field``, null where there is none."""
    own = F.col("field") == field
    rows = facts.select("entity", "amount", F.when(own, F.col("status")).alias("status"), F.when(own, F.col("is_noise")).alias("is_noise"), "date", "is_amendment", "block_id", "seq")
    return _best(rows, ["entity"]).select("entity", "best.amount")


def superseded(evidence: DataFrame) -> DataFrame:
    """Evidence (block_id, source_file, entity, date) with ``reason``, null for what holds:
    of an entity with several blocks, a base document beside amendments is obsolete, so is
    an amendment older than the latest one, and anything else older than the latest."""
    path = F.col("source_file")
    rows = evidence.withColumns({"is_amendment": T.is_amendment(path), "is_base": T.is_base(path)})
    known = F.col("date.y") != -1
    of_entity = rows.groupBy(F.col("entity").alias("_e")).agg(
        F.count("*").alias("_n"), F.max("is_amendment").alias("_amended"),
        F.max(F.when(known, F.col("date"))).alias("_latest"), F.max(F.when(known & F.col("is_amendment"), F.col("date"))).alias("_amendment"),
    )
    rows = rows.join(of_entity, F.col("entity").eqNullSafe(F.col("_e")))
    reason = (
        F.when((F.col("_n") > 1) & F.col("is_base") & F.col("_amended"), "amended")
        .when((F.col("_n") > 1) & known & F.col("is_amendment") & (F.col("_amendment") > F.col("date")), "later amendment")
        .when((F.col("_n") > 1) & known & ~F.col("is_amendment") & (F.col("_latest") > F.col("date")), "later date")
    )
    return rows.withColumn("reason", reason).drop("_e", "_n", "_amended", "_latest", "_amendment")


def current_owners(facts: DataFrame) -> DataFrame:
    """(owner, entity) of active owner facts that no other owner's later fact replaces."""
    date, dated = F.col("date"), F.col("date.y") != -1
    owners = facts.where("field = 'owner' AND status = 'active'").groupBy("entity", F.col("value").alias("owner")).agg(F.max(F.when(dated, date)).alias("own"), F.max(~dated).alias("undated"))
    latest = F.max("own").over(Window.partitionBy("entity"))  # a row per owner of the entity
    return owners.withColumn("latest", latest).where("undated OR own >= latest").select("owner", "entity")


def owned_amounts(facts: DataFrame, field: str) -> DataFrame:
    """(owner, entity, amount): ``current_owners`` with the resolved amount of ``field``, of
    entities that have both. One pass over the facts: an entity's owners are a row each, its
    facts of ``field`` one more."""
    date, dated, own = F.col("date"), F.col("date.y") != -1, F.col("field") == field
    owner = F.when((F.col("field") == "owner") & (F.col("status") == "active"), F.col("value"))
    best = F.struct("date", "is_amendment", (-F.col("block_id")).alias("block"), (-F.col("seq")).alias("seq"), "amount")
    first = lambda noise: F.max(F.when(own & (F.col("status") == "active") & (F.col("is_noise") == noise), best))
    rows = facts.withColumn("owner", owner).where(own | F.col("owner").isNotNull()).groupBy("entity", "owner").agg(
        F.max(F.when(F.col("owner").isNotNull() & dated, date)).alias("own"), F.max(F.col("owner").isNotNull() & ~dated).alias("undated"),
        F.max(F.when(own, ~F.col("is_noise"))).alias("clean"), first(False).alias("of_clean"), first(True).alias("of_noise"),
    )
    each = Window.partitionBy("entity")  # a row per owner of the entity, and one
    latest, found = F.max("own").over(each), F.max(F.when(F.col("clean"), F.col("of_clean")).otherwise(F.col("of_noise"))).over(each)
    rows = rows.withColumns({"latest": latest, "found": found}).where("owner IS NOT NULL AND found IS NOT NULL AND (undated OR own >= latest)")
    return rows.select("owner", "entity", "found.amount")


def compared(pairs: DataFrame, values: DataFrame, mentioned: DataFrame | None = None, higher: bool = True) -> DataFrame:
    """``pairs`` (pair_id, a, b) with status, answer and amount: the entity of the higher
    (lower) amount in ``values`` (entity, amount). Unknown entities, missing amounts and
    ties have a status each. Without ``mentioned`` the entities of ``values`` are the known
    ones. Both sides of a pair meet the values in one join."""
    v = values.select("entity", "amount", F.lit(True).alias("known"))
    if mentioned is not None:
        v = mentioned.select("entity", F.lit(True).alias("known")).join(values.select("entity", "amount"), "entity", "full").select("entity", "amount", "known")
    sides = pairs.select("pair_id", "a", "b", F.posexplode(F.array("a", "b")).alias("side", "entity")).join(v, "entity", "left")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = sides.groupBy("pair_id", "a", "b").agg(*[of(i, c).alias(f"{x}_{c}") for i, x in enumerate("ab") for c in ("amount", "known")])
    a, b = F.col("a_amount"), F.col("b_amount")
    first = (a > b) if higher else (a < b)
    status = (
        F.when(F.col("a_known").isNull() | F.col("b_known").isNull(), "NOT_FOUND").when(a.isNull() | b.isNull(), "KERNEL_MISSING_FIELD")
        .when(a == b, "INSUFFICIENT_EVIDENCE").otherwise("PASS")
    )
    amount = F.when(first, a).otherwise(b)
    answer = F.concat(F.lit("Project "), F.when(first, F.col("a")).otherwise(F.col("b")), F.lit(" (budget of "), T.money(amount), F.lit(")"))
    return rows.withColumn("status", status).select("pair_id", "a", "b", "status", F.when(F.col("status") == "PASS", answer).otherwise(F.col("status")).alias("answer"), F.when(F.col("status") == "PASS", amount).alias("amount"))


def looked_up(asked: DataFrame, answers: DataFrame, mentioned: DataFrame) -> DataFrame:
    """``asked`` (qid, entity, field, position) answered from ``answers`` (entity, field,
    value): per question the values joined by " and ", or the status of the first that
    fails."""
    rows = asked.join(answers.select("entity", "field", "value"), ["entity", "field"], "left").join(mentioned.select("entity", F.lit(True).alias("known")), "entity", "left")
    status = F.when(F.col("value").isNotNull(), "PASS").when(F.col("known"), "KERNEL_MISSING_FIELD").otherwise("NOT_FOUND")
    parts = F.array_sort(F.collect_list(F.struct("position", status.alias("status"), "value")))
    rows = rows.groupBy("qid").agg(parts.alias("parts"))
    failed = F.filter("parts", lambda p: p["status"] != "PASS")
    answer = F.when(F.size(failed) > 0, F.element_at(failed, 1)["status"]).otherwise(F.array_join(F.transform("parts", lambda p: p["value"]), " and "))
    return rows.select("qid", answer.alias("answer"))


def mentioned_entities(facts: DataFrame) -> DataFrame:
    return facts.select("entity").distinct()


def field_coverage(text: Column, field: str, names: tuple[str, ...] = ()) -> Column:
    """Whether a text speaks of a field."""
    words = {"budget": ("budget", "$"), "deadline": ("deadline", "date"), "owner": ("owner", "author", "manager", *names), "department": ("department", "unit", *names), "location": ("location", "based in", *names)}
    return T.contains_any(F.lower(text), tuple(w.lower() for w in words[field]))


def proof_status(n_active: Column, n_suppressed: Column, completeness: Column) -> Column:
    return (
        F.when((n_active == 0) & (n_suppressed == 0), "ABSENT").when(n_active == 0, "INSUFFICIENT")
        .when(completeness == 1.0, "COMPLETE").when(completeness > 0.0, "PARTIAL").otherwise("INSUFFICIENT")
    )


def guard_action(proof: Column, intent: Column, n_entities: Column, n_active: Column, bypass: Column) -> Column:
    """What to do with a question: bypass the model, go on, or go on with a warning."""
    return (
        F.when((proof == "ABSENT") | ((intent != "aggregation") & ((n_entities == 0) | (n_active == 0))), "BYPASS_LLM")
        .when((proof == "COMPLETE") & ~intent.isin("comparison", "aggregation") & bypass.isNotNull(), "BYPASS_LLM")
        .when(proof == "PARTIAL", "PROCEED_WITH_WARNING").otherwise("PROCEED")
    )
