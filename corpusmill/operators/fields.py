"""Fields of single texts by ordered patterns, then by lists of names; names brought to
their canonical form by a dimension of people and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small

# The patterns of a field, tried in this order, any case.
_MONEY = r"(\$\d{1,3}(?:,\d{3})*)"
_DAY = r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})"
FIELD_PATTERNS = {
    "budget": (
        rf"updated budget is increased to\s+{_MONEY}", rf"updated budget to\s+{_MONEY}", rf"official budget for Project\s+[A-Za-z0-9_\-]+\s+is\s+{_MONEY}", rf"Approved Budget:\s+{_MONEY}",
        rf"financial allocation request of\s+{_MONEY}\s+was approved", rf"budget is\s+{_MONEY}", rf"budget of\s+[A-Za-z0-9_\-]+\s+was\s+{_MONEY}", rf"budget of\s+{_MONEY}", _MONEY,
    ),
    "deadline": (
        rf"officially extended to\s+{_DAY}", rf"final deadline of Project\s+[A-Za-z0-9_\-]+\s+is set to\s+{_DAY}", rf"Completion Date:\s+{_DAY}", rf"milestone deadline is set to\s+{_DAY}",
        rf"Delivery Date:\s+{_DAY}", rf"completion is set to\s+{_DAY}", _DAY,
    ),
    "department": (r"Department:\s*([A-Za-z]+)", r"Lead Unit:\s*([A-Za-z]+)", r"overseen by the\s*([A-Za-z]+)\s+unit"),
    "location": (r"Location:\s*([A-Za-z]+)", r"based in\s*([A-Za-z]+)"),
}
# The departments, a committee that isn't one, and what makes it one.
DEPARTMENTS = ("Engineering", "Finance", "HR", "Legal", "Marketing", "Operations", "Sales")
COMMITTEE, ITS_DEPARTMENT = "finance committee", ("department: finance", "lead unit: finance")


def _first_named(text: Column, names: tuple[str, ...], of_text) -> Column:
    """The first of ``names``, in their order, that ``of_text`` finds; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda n: of_text(text, n)), F.lit(0)) if names else F.lit(None).cast("string")


def field_value(text: Column, field: str, names: tuple[str, ...] = ()) -> Column:
    """A field's value in a text, or null. Budgets and deadlines are what the first pattern
    that fits takes; departments and locations too if that is one of ``names`` as spelled
    there, else the first name that stands as a word; an owner is the first name found."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    patterns = FIELD_PATTERNS.get(field, ())
    if field in ("budget", "deadline"):
        return F.coalesce(*[T.found(flat, f"(?i){p}", 1) for p in patterns])
    lowered = F.lower(text)
    if field == "owner":
        return _first_named(text, names, lambda t, n: F.contains(lowered, F.lower(n)))
    told = [F.regexp_extract(flat, f"(?i){p}", 1) for p in patterns]
    word = lambda t, n: F.regexp_like(t, F.concat(F.lit(r"(?i)\b"), T.quoted(n), F.lit(r"\b")))
    if field == "department":  # the committee isn't the department
        only_committee = F.contains(lowered, F.lit(COMMITTEE)) & ~T.contains_any(lowered, ITS_DEPARTMENT)
        stands = lambda t, n: word(t, n) & ~((F.lower(n) == "finance") & only_committee)
    else:
        stands = word
    return F.coalesce(*[F.when(t.isin(*names), t) for t in told], _first_named(text, names, stands))


def exact_project(text: Column, entity: Column) -> Column:
    """Whether a text names ``entity`` anywhere without a suffix like -A after it; what
    else follows doesn't matter; any case."""
    return F.regexp_like(F.lower(text), F.concat(T.quoted(F.lower(entity)), F.lit(r"(?!-[\p{L}\p{N}])")))


def json_list(value: Column) -> Column:
    """The strings of a JSON list; another text is a list of itself, none or an empty one
    an empty list."""
    nothing = F.array().cast("array<string>")
    listed = F.from_json(value, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", nothing).when(F.startswith(F.ltrim(value), F.lit("[")) & listed.isNotNull(), listed).otherwise(F.array(value))


def canonical_names(raw: DataFrame, people: DataFrame) -> DataFrame:
    """(raw, name) of the distinct ``raw`` names: the person (people: place, name, aliases)
    whose name or alias it is, accents and case aside; else the first with that first name
    and last initial; else the first whose name holds it; else null. The first two are
    equi-joins; what is left meets the people, a dimension, by containment. A null or
    empty name is nobody's."""
    folded = lambda c: F.trim(F.lower(T.fold_accents(c)))
    parts, own = F.split(F.trim("raw"), r"\s+"), F.split("name", r"\s+")
    names = raw.select("raw").distinct().where(F.trim("raw") != "").select("raw", folded(F.col("raw")).alias("key"), F.when(F.size(parts) >= 2, F.concat_ws("|", folded(parts[0]), F.regexp_replace(F.lower(parts[1]), r"\.+$", ""))).alias("short"))
    every = people.select("place", "name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), folded))).alias("key"))
    initials = people.where(F.size(own) >= 2).select("place", "name", F.concat_ws("|", folded(own[0]), F.lower(F.substring(own[1], 1, 1))).alias("short"))
    first = lambda df, by: df.groupBy(by).agg(F.min(F.struct("place", "name")).alias("p")).select(by, F.col("p.name").alias("name"))
    rows = names.join(broadcast_if_small(first(every, "key")), "key", "left").withColumnRenamed("name", "exact")
    rows = rows.join(broadcast_if_small(first(initials, "short")), "short", "left").withColumn("found", F.coalesce("exact", "name")).select("raw", "key", "found")
    loose = rows.where("found IS NULL").join(broadcast_if_small(people.select("place", "name")), F.contains(folded(F.col("name")), F.col("key")))
    return rows.join(first(loose, "raw"), "raw", "left").select("raw", F.coalesce("found", "name").alias("name"))
