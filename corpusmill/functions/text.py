"""Text functions as Column expressions: tokens, sentences, dates, amounts, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists and patterns that results depend on.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ENTITY_STOP = (
    "project", "amendment", "contract", "division", "status", "update", "technical", "report", "service", "summary", "specifications",
    "internal", "only", "to", "no", "kv", "approved budget", "completion date", "delivery date", "detailed analysis", "executive summary",
    "financial overview", "financial request", "key takeaways", "lead unit", "legacy", "mobile", "operations analyst", "project owner",
    "security classification", "target entity", "timeline", "finance committee", "archive", "operational", "optimization", "analysis",
    "takeaways", "author", "department", "location", "officially", *MONTHS,
)
ENTITY_STOP_PARTS = ("location", "approved", "timeline", "noise")
WEAK_TERMS = (
    "a", "all", "an", "and", "by", "evidence", "for", "in", "list", "managed", "management", "name", "names", "of", "or", "project",
    "projects", "scale", "semantic", "the", "to", "up", "using", "with",
)
QUESTION_WORDS = (
    "what", "which", "where", "when", "who", "how", "why", "the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "with",
    "is", "are", "was", "were",
)
FIELD_KEYWORDS = {
    "budget": ("budget", "coût", "montant", "prix", "cost", "amount", "financial"),
    "deadline": ("deadline", "date", "quand", "when", "échéance", "délai", "delivery date"),
    "owner": ("manager", "owner", "responsable", "directeur", "director", "who", "author", "technician"),
    "department": ("department", "unit", "division", "service"),
    "location": ("location", "où", "where", "site", "city", "pays", "ville"),
}
COMPARISON_WORDS = ("compare", "vs", "différence", "higher", "lower", "larger", "smaller")
LISTING_WORDS = ("list all", "summarize all", "all project", "projects managed by")
STATUS_WORDS = ("obsolete", "active", "updated", "supersede", "revised", "contract", "amendment")
OBSOLETE_SIGNALS = (
    "old memo", "old record", "previously", "former", "was renamed to", "was reassigned", "deprecated", "superseded", "archive", "obsolete", "was $",
)
ACTIVE_SIGNALS = ("extended to", "officially extended", "new budget", "updated budget", "increased to", "is currently", "is active")
HEADER_PREFIXES = ("from:", "to:", "subject:", "date:", "cc:", "bcc:", "supersedes:")
BUDGET_PATTERNS = (
    r"(\$\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?)",
    r"(\b\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\s*(?:usd|dollars|dollar|m|k|million|thousand)\b)",
    r"(usd\s*\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\s*(?:k|m)?)",
    r"(\b\d+(?:\.\d+)?\s*(?:m|k|million|thousand)\b)",
    r"(\b\d{4,12}\b)",
)
DATE_PATTERN = r"\b(\d{1,2})\s+([a-zA-Z]+)\s+(\d{4})\b"
MARKER_PATTERN = r"\bref_[0-9a-f]{10}\b"
MONEY_PATTERN = r"\$[0-9][0-9,]*(?:\.[0-9]+)?"
PROJECT_PATTERN = r"\bProject\s+[A-Z][A-Z0-9_-]*\b"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# --- tokens ------------------------------------------------------------------------------


def index_tokens(text: Column) -> Column:
    return matches(F.lower(text), "[a-z0-9_]+")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def code_tokens(text: Column) -> Column:
    return F.transform(matches(text, "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lower)


def alnum_tokens(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(words(text)))


def clean_text(text: Column) -> Column:
    """Lines without outer white space, empty ones dropped."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def chunks(tokens: Column, size: int = 128) -> Column:
    """Arrays of ``size`` tokens, one after the other; none of no tokens."""
    last = F.floor((F.size(tokens) - 1) / size).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def hashing_buckets(tokens: Column, dim: int = 128) -> Column:
    """A bucket per token: the first byte of its SHA-256, modulo ``dim`` (a power of two
    up to 256)."""
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.sha2(t, 256), 1, 2), 16, 10).cast("int"), F.lit(dim)))


# --- entities ----------------------------------------------------------------------------


def entity_candidates(text: Column) -> Column:
    """Names in capitals and pairs of capitalised words, without generic ones."""
    names = F.array_distinct(F.concat(matches(text, r"\b[A-Z][A-Z0-9_\-]+"), matches(text, r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")))
    stop = F.array(*map(F.lit, ENTITY_STOP))
    return F.filter(names, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, F.lower(x)) & ~contains_any(F.lower(x), ENTITY_STOP_PARTS))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def quoted(entity: Column) -> Column:
    return F.concat(F.lit(r"\Q"), entity, F.lit(r"\E"))


def mentions(text: Column, entity: Column) -> Column:
    """``entity`` between characters that can't belong to a longer name; any case."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![a-zA-Z0-9_\-])"), quoted(F.lower(entity)), F.lit(r"(?![a-zA-Z0-9_\-])")))


def mentions_revision(text: Column, entity: Column) -> Column:
    """As ``mentions``, accents folded, a revision suffix like -r2 allowed."""
    name = quoted(F.lower(fold_accents(entity)))
    return F.regexp_like(F.lower(fold_accents(text)), F.concat(F.lit(r"(?<![a-zA-Z0-9_\-])"), name, F.lit(r"(?:-r\d*)?(?![a-zA-Z0-9_\-])")))


def suffixes(text: Column, entity: Column) -> Column:
    """What directly follows ``entity`` where it begins a longer name."""
    return F.regexp_extract_all(F.lower(text), F.concat(F.lit(r"(?<![a-zA-Z0-9_\-])"), quoted(F.lower(entity)), F.lit(r"([a-zA-Z0-9_\-]+)")), F.lit(1))


def base_name(entity: Column) -> Column:
    return F.trim(F.regexp_replace(entity, "[Pp]roject ", ""))


def unseen_entities(question: Column) -> Column:
    capitals = matches(question, r"\b[A-Z][A-Z0-9_\-]+\b")
    return F.when(F.size(capitals) > 0, capitals).otherwise(matches(question, r"\b[A-Z][a-z]+\b"))


# --- questions ---------------------------------------------------------------------------


def required_fields(question: Column) -> Column:
    """Fields whose keywords a question holds, in order of first position."""
    lowered = F.lower(question)
    order = {f: i for i, f in enumerate(FIELD_KEYWORDS)}
    places = []
    for name, keywords in FIELD_KEYWORDS.items():
        first = F.array_min(F.filter(F.array(*[F.instr(lowered, k) for k in keywords]), lambda p: p > 0))
        places.append(F.struct(first.alias("at"), F.lit(order[name]).alias("n"), F.lit(name).alias("field")))
    return F.transform(F.array_sort(F.filter(F.array(*places), lambda p: p["at"].isNotNull())), lambda p: p["field"])


def intent(question: Column, fields: Column, n_entities: Column) -> Column:
    lowered = F.lower(question)
    return (
        F.when(n_entities == 0, "abstention_candidate")
        .when(F.size(fields) >= 2, "multi_fact_extraction")
        .when(contains_any(lowered, COMPARISON_WORDS), "comparison")
        .when(contains_any(lowered, LISTING_WORDS), "aggregation")
        .when(contains_any(lowered, STATUS_WORDS), "status_resolution")
        .otherwise("single_fact_lookup")
    )


def reference_marker(text: Column) -> Column:
    return found(F.lower(text), MARKER_PATTERN)


def canonical_hash(question: Column, entities: Column, fields: Column, intent_: Column, marker: Column) -> Column:
    """SHA-256 of a question and its parse; case and white space don't matter."""
    status = F.when(intent_ == "status_resolution", "all").otherwise("active")
    constraints = F.concat_ws(",", F.concat(F.lit("reference_marker="), F.lower(marker)), F.concat(F.lit("status_preference="), status), F.lit("strict_entity=true"), F.lit("temporal_preference=latest"))
    lowered = F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))
    joined = lambda xs: F.array_join(F.array_sort(F.transform(xs, F.lower)), ",")
    text = F.concat(F.lit("question:"), lowered, F.lit("|entities:"), joined(entities), F.lit("|fields:"), joined(fields), F.lit("|intent:"), F.lower(intent_), F.lit("|constraints:"), constraints)
    return F.sha2(text, 256)


# --- dates and amounts -------------------------------------------------------------------


def date_parts(text: Column) -> Column:
    """struct(y, m, d): of the first "day month year" (m from 0, -1 if no month), else
    the latest year from 1990 to 2100, else all -1. Structs compare like dates."""
    day, month, year = (F.regexp_extract(text, DATE_PATTERN, i) for i in (1, 2, 3))
    at = F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("int"), F.lit(0)) - 1
    years = F.filter(F.transform(matches(text, r"\b(\d{4})\b", 1), lambda y: y.cast("int")), lambda y: y.between(1990, 2100))
    return F.when(
        day != "", F.struct(year.cast("int").alias("y"), at.alias("m"), day.cast("int").alias("d"))
    ).otherwise(F.struct(F.coalesce(F.array_max(years), F.lit(-1)).alias("y"), F.lit(-1).alias("m"), F.lit(-1).alias("d")))


def budget_string(line: Column) -> Column:
    first, united, usd, short, plain = (found(line, f"(?i){p}", 1) for p in BUDGET_PATTERNS)
    unit = F.regexp_like(line, F.lit(r"(?i)\d\s*[udmkt]"))  # without a digit before a unit's letter neither pattern of units matches
    return F.coalesce(F.when(F.contains(line, F.lit("$")), first), F.when(unit, united), F.when(F.contains(F.lower(line), F.lit("usd")), usd), F.when(unit, short), plain)


def normalized_budget(text: Column, years: bool = False) -> Column:
    """Whole units: millions and thousands spelled out, separators dropped, fractions cut;
    null for bare years, unless ``years`` count as amounts."""
    t = F.lower(F.trim(text))
    million, thousand = found(t, r"([\d\.]+)\s*(?:m|million)", 1), found(t, r"([\d\.]+)\s*(?:k|thousand)", 1)
    plain = found(F.regexp_replace(t, r"[$,\s]", ""), r"^\d+(\.\d+)?")
    year = found(t, r"^\d{4}$").cast("int").between(1990, 2100)
    number = lambda x, by: (x.try_cast("double") * by).cast("bigint")
    return F.when(F.coalesce(year, F.lit(False)) & F.lit(not years), F.lit(None).cast("bigint")).otherwise(F.coalesce(number(million, 1_000_000), number(thousand, 1_000), number(plain, 1)))


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("bigint"), 0))


def line_status(line: Column) -> Column:
    lowered = F.lower(line)
    return F.when(contains_any(lowered, OBSOLETE_SIGNALS) & ~contains_any(lowered, ACTIVE_SIGNALS), "obsolete").otherwise("active")


def is_header_line(line: Column) -> Column:
    return F.regexp_like(F.lower(F.ltrim(line)), F.lit("^(" + "|".join(HEADER_PREFIXES) + ")"))


def is_noise_path(path: Column) -> Column:
    return contains_any(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), ("noise", "adv_doc"))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))


def is_amendment(path: Column) -> Column:
    return contains_any(file_name(path), ("amendment", "update"))


def is_base(path: Column) -> Column:
    name = file_name(path)
    return F.contains(name, F.lit("base")) | (F.contains(name, F.lit("contract")) & ~F.contains(name, F.lit("amendment")))


# --- answers -----------------------------------------------------------------------------


def plain_answer(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def token_sorted_answer(text: Column) -> Column:
    """Without $, commas and the word project, accents folded, words sorted."""
    t = F.lower(fold_accents(F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,]", "")))
    return F.array_join(F.array_sort(F.filter(words(t), lambda w: w != "project")), " ")


def bare_answer(text: Column) -> Column:
    """Without punctuation and articles."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", "")
    return F.array_join(F.filter(words(t), lambda w: ~w.isin("a", "an", "the")), " ")


def contained_match(answer: Column, expected: Column) -> Column:
    """Equal, or the expected inside an answer that isn't much longer."""
    a, e = bare_answer(answer), bare_answer(expected)
    return (a == e) | ((e != "") & F.contains(a, e) & (F.length(a) < 4 * F.length(e) + 30))


def numbers_kept(answer: Column, expected: Column) -> Column:
    """Every run of digits of the expected answer occurs in the answer."""
    kept = matches(answer, r"\d+")
    return F.forall(matches(expected, r"\d+"), lambda n: F.array_contains(kept, n))


def grounding_terms(text: Column) -> Column:
    return F.array_distinct(F.concat(matches(text, r"\b\$?\d+(?:,\d+)*(?:\.\d+)?(?:M€|k|M)?\b"), matches(text, r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")))


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else what lies from its first { to its last },
    else null."""
    whole = F.trim(text)
    part = found(text, r"(?s)\{.*\}")
    ok = lambda x: F.when(F.get_json_object(x, "$").isNotNull() & F.startswith(x, F.lit("{")), x)
    return F.coalesce(ok(whole), ok(part))


# --- sets of a question or sentence --------------------------------------------------------


def feature_sets(text: Column) -> dict[str, Column]:
    distinct = lambda pattern: F.array_distinct(matches(text, pattern))
    lowered = F.array_distinct(lower_words(text))
    return {
        "tokens": lowered,
        "numbers": distinct(r"\b\d+(?:\.\d+)?\b"),
        "acronyms": distinct(r"\b[A-Z]{2,}\b"),
        "names": distinct(r"\b[A-Z][a-z]{2,}\b"),
        "dates": distinct(r"\b\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
        "quoted": distinct(r'"[^"]+"'),
        "hyphenated": distinct(r"\b\w+-\w+\b"),
        "content": F.array_except(lowered, F.array(*map(F.lit, QUESTION_WORDS))),
    }


# --- ids and paths -------------------------------------------------------------------------


def safe_id(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), 1, most)


def opaque_id(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def sentence_key(config: Column, case: Column, key: Column) -> Column:
    """'0a' of a case as config/case/doc_0/a."""
    return F.concat_ws("/", config, case, F.concat(F.lit("doc_"), F.regexp_extract(key, r"^(\d+)", 1)), F.regexp_extract(key, r"([a-z]+)$", 1))


def code_paths(text: Column, suffix: str = "py") -> Column:
    """File paths of a text, without what lies before an installed or checked-out root."""
    paths = matches(text, rf"[A-Za-z0-9_./\\-]+\.{suffix}\b")
    clean = F.transform(paths, lambda p: F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^.*/(site-packages|dist-packages|src)/", ""), r"^(\./|/)+", ""))
    return F.array_distinct(clean)


def code_symbols(text: Column, stop: tuple[str, ...] = ("self", "none", "true", "false", "return", "import", "from", "class", "def", "error", "traceback")) -> Column:
    """Identifiers that look like code: dunder, snake or camel case, three letters or more."""
    names = F.array_distinct(matches(text, r"\b(?:__[a-z]+__|[a-z]+(?:_[a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"))
    return F.filter(names, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*stop))
