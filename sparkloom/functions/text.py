"""Query and document text: normalising, classifying, masking, hashing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .spans import ascii_bounds

# Word lists and patterns that decide results.
QUESTION_WORDS = ("who", "what", "where", "when", "why", "how", "which", "whose")
GREETINGS = (
    r"^(hi|hello|hey|howdy|greetings|yo|hiya)[\s!.,?]*$",
    r"^(good\s+(morning|afternoon|evening|day))[\s!.,?]*$",
    r"^(what'?s\s+up|sup|wassup)[\s!.,?]*$",
    r"^hi\s+there[\s!.,?]*$",
)
CLOSINGS = (
    r"^(thanks|thank\s+you|thx|ty|cheers)[\s!.,?]*$",
    r"^(bye|goodbye|see\s+you|later|take\s+care)[\s!.,?]*$",
    r"^(ok|okay|got\s+it|understood|perfect|great)[\s!.,?]*$",
)
GREETING_WORDS = (
    "hi", "hello", "hey", "thanks", "bye", "ok", "okay", "cool", "nice", "great", "awesome", "sure", "yes", "no", "yep", "nope",
)
QUESTION_TYPES = {
    "factual": (
        r"\b(what\s+is|what\s+are|what's|whats)\b",
        r"\b(who\s+is|who\s+are|who's|whos)\b",
        r"\b(where\s+is|where\s+are|where's|wheres)\b",
        r"\b(when\s+is|when\s+are|when\s+was|when\s+did)\b",
        r"\b(define|definition\s+of)\b",
        r"\b(name|list)\b",
    ),
    "analytical": (
        r"\b(why\s+is|why\s+are|why\s+did|why\s+do)\b",
        r"\b(compare|comparison|versus|vs\.?|differ|difference)\b",
        r"\b(analyze|analysis|evaluate|evaluation)\b",
        r"\b(better|worse|best|worst|pros?\s+and\s+cons?)\b",
        r"\b(advantages?|disadvantages?|benefits?|drawbacks?)\b",
        r"\b(trade-?offs?|implications?)\b",
    ),
    "procedural": (
        r"\b(how\s+to|how\s+do\s+i|how\s+can\s+i|how\s+should)\b",
        r"\b(steps?\s+to|guide\s+to|tutorial)\b",
        r"\b(implement|install|setup|configure|create)\b",
        r"\b(fix|solve|resolve|troubleshoot)\b",
        r"\b(build|make|write|develop)\b",
    ),
    "clarification": (
        r"\b(what\s+do\s+you\s+mean|can\s+you\s+explain)\b",
        r"\b(clarify|elaborate|more\s+detail)\b",
        r"\b(i\s+don'?t\s+understand|confused)\b",
        r"\b(could\s+you\s+expand|tell\s+me\s+more)\b",
        r"\b(what\s+about|how\s+about)\b",
    ),
}
MULTI_PART = (
    r"\band\s+also\b",
    r"\badditionally\b",
    r"\bfurthermore\b",
    r"\bmoreover\b",
    r",\s*and\s+",
    r"\?\s+and\s+",
    r"\balso\b.*\?",
    r"\b(first|second|third|finally)\b",
)
MODIFIERS = (
    r"\b(before|after|during|while|since|until)\b",
    r"\b(compare|comparison|versus|vs\.?)\b",
    r"\b(better|worse|best|worst)\b",
    r"\b(more|less|most|least|rather)\b",
    r"\b(different|similar|same|unlike|like)\b",
    r"\b(if|when|assuming|given\s+that|suppose)\b",
    r"\b(however|although|despite|whereas|while)\b",
    r"\b(first|second|third|then|finally|lastly)\b",
)
CLAUSES = (r"[,;]", r"\b(and|or|but|because|since|although|while|whereas|if|when|that|which)\b")
COMPARISON = (
    r"\bcompare\s+",
    r"\bdifference\s+between\b",
    r"\bvs\.?\s+",
    r"\bversus\s+",
    r"\bbetter\s+than\b",
    r"\bhow\s+does\s+.+\s+differ\b",
    r"\bsimilarit(?:y|ies)\s+and\s+difference",
    r"\bcontrast\b",
    r"\bwhich\s+is\s+better\b",
    r"\bpros\s+and\s+cons\b",
)
AGGREGATION = (
    r"\blist\s+all\b",
    r"\bwhat\s+are\s+all\b",
    r"\bsummarize\s+",
    r"\boverview\s+of\b",
    r"\beverything\s+about\b",
    r"\ball\s+the\s+",
    r"\benumerate\b",
    r"\bcollect\s+",
)
SEQUENTIAL = (
    r"\bfirst.+then\b",
    r"\bstep\s+by\s+step\b",
    r"\bwhat\s+happens\s+.+\s+and\s+then\b",
    r"\bafter\s+that\b",
    r"\bbefore\s+and\s+after\b",
    r"\bsequence\s+of\b",
    r"\bprocess\s+for\b",
)
MULTI_ENTITY = (r"\bboth\s+.+\s+and\s+", r"\bbetween\s+.+\s+and\s+", r"(\w+),\s*(\w+),?\s*and\s+(\w+)")
COMPLEX = (r"\banalyze\b", r"\bsummarize multiple\b", r"\bacross\b", r"\brelationship between\b")
SMALL_TALK = (r"\bhello\b", r"\bhi\b", r"\bhey\b", r"\bthanks\b", r"\bthank you\b", r"\bgoodbye\b", r"\bbye\b", r"\bhow are you\b")
INJECTIONS = (
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"forget\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"(reveal|show|display|print|output)\s+(your\s+)?(system\s+)?prompt",
    r"what\s+(is|are)\s+(your\s+)?(system\s+)?instructions?",
    r"(tell|show)\s+me\s+(your\s+)?(system\s+)?prompt",
    r"you\s+are\s+now\s+(a\s+)?new\s+ai",
    r"pretend\s+(you\s+are|to\s+be)\s+a\s+different\s+ai",
    r"act\s+as\s+(if\s+you\s+are\s+)?(a\s+)?different\s+ai",
    r"(dan|dude|developer)\s+mode",
    r"jailbreak",
    r"bypass\s+(your\s+)?(safety|security|restrictions?)",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
    r"\[INST\]",
    r"\[/INST\]",
    r"<<SYS>>",
    r"<</SYS>>",
    r"execute\s+(the\s+)?following\s+(code|command|script)",
    r"run\s+(the\s+)?following\s+(code|command|script)",
)
HARMS = (
    (r"\b(kill|murder|assassinate)\s+(you|yourself|them|him|her)\b", "violence", "high"),
    (r"\b(how\s+to\s+make\s+a?\s*)?(bomb|explosive|weapon)\b", "violence", "critical"),
    (r"\bterrorist?\s+(attack|plot)\b", "violence", "critical"),
    (r"\bhow\s+to\s+(commit\s+)?suicide\b", "self_harm", "critical"),
    (r"\bharm\s+(myself|yourself)\b", "self_harm", "high"),
    (r"\bhow\s+to\s+(hack|crack)\s+(into|a)\b", "illegal", "high"),
    (r"\b(buy|sell|obtain)\s+illegal\s+(drugs|weapons)\b", "illegal", "high"),
    (r"\bexterminate\s+(all\s+)?(the\s+)?[a-z]+s?\b", "hate", "critical"),
)
# Fixed values, in the order of redaction: type and pattern.
PII = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "SSN": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "PHONE_NUMBER": r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "DATE": r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    "PASSPORT": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "BANK_ACCOUNT": r"\b[0-9]{8,17}\b",
    "DRIVERS_LICENSE": r"\b[A-Z]{1,2}[0-9]{5,8}\b",
    "MEDICAL_RECORD": r"\b(?:MRN|MR#?|Medical Record)[:\s]?[A-Z0-9]{6,12}\b",
}
SENSITIVE = ("SSN", "CREDIT_CARD", "BANK_ACCOUNT", "MEDICAL_RECORD")
SECRETS = (
    (r"(?i)password=[\w\-]+", "password=***"),
    (r"(?i)pwd=[\w\-]+", "pwd=***"),
    (r"(?i)secret=[\w\-]+", "secret=***"),
    (r"(?i)token=[\w\-\.]+", "token=***"),
    (r"(?i)api[_-]?key=[\w\-]+", "api_key=***"),
    (r"(?i)Bearer\s+[\w\-\.]+", "Bearer ***"),
    (r"(?i)Basic\s+[\w\+/=]+", "Basic ***"),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "***JWT***"),
    (r"(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}", "***AWS_KEY***"),
)
KEY_TERM_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "and", "or", "but", "if", "then", "that", "this", "these", "those", "it", "its", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further",
    "once", "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very",
)
# Parts of names whose values are never logged.
SENSITIVE_KEYS = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "authorization", "auth", "credential", "credentials",
    "private_key", "privatekey", "access_token", "refresh_token", "jwt", "bearer", "connection_string", "database_url", "redis_password",
    "postgres_password", "opensearch_password",
)
MODEL_TIERS = {
    ("basic", "simple"): "small",
    ("basic", "complex"): "small",
    ("standard", "simple"): "small",
    ("standard", "complex"): "medium",
    ("premium", "simple"): "medium",
    ("premium", "complex"): "large",
}
STRATEGY_COMPLEXITY = {"no_retrieval": 0.0, "simple": 0.25, "complex": 0.75, "multi_hop": 0.9, "comparison": 0.9, "aggregation": 0.9}


def any_match(text: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """One scan of the text for all patterns."""
    flag = "(?i)" if ignore_case else ""
    return text.rlike(flag + "|".join(f"(?:{ascii_bounds(p)})" for p in patterns))


def hits(text: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """How many of the patterns occur."""
    flag = "(?i)" if ignore_case else ""
    return sum((text.rlike(flag + ascii_bounds(p)).cast("int") for p in patterns), F.lit(0))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def query_type(text: Column) -> Column:
    low = F.lower(text)
    starts = low.rlike(r"^(" + "|".join(QUESTION_WORDS) + r")(\s|$)")
    holds = reduce(or_, [F.contains(low, F.lit(w)) for w in QUESTION_WORDS])
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(text.contains('"') | text.contains("'"), "semantic").when(text.contains("?") | starts, "question").when((words <= 2) & ~holds, "simple").otherwise("hybrid")
    )


def search_mode(kind: Column) -> Column:
    return F.when(kind == "simple", "keyword").when(kind.isin("question", "semantic"), "semantic").otherwise("hybrid")


def greeting(text: Column) -> Column:
    """Confidence that the text is small talk: .95, .90, .80 or 0."""
    t = F.lower(F.trim(text))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    short = (F.length(t) < 15) & ~t.contains("?") & (F.size(words) <= 3) & F.exists(words, lambda w: w.isin(*GREETING_WORDS))
    return F.when(any_match(t, GREETINGS), 0.95).when(any_match(t, CLOSINGS), 0.9).when(short, 0.8).otherwise(0.0)


def question_type(text: Column) -> tuple[Column, Column]:
    """The class with most hits, the first of equals, and its confidence."""
    t = F.lower(F.trim(text))
    counts = {k: F.least(0.6 + hits(t, p) * 0.15, F.lit(0.95)) for k, p in QUESTION_TYPES.items()}
    found = {k: F.when(hits(t, p) > 0, counts[k]) for k, p in QUESTION_TYPES.items()}
    best = F.greatest(*found.values())
    name = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in found.items()], F.lit("unknown"))
    return name, F.coalesce(best, F.lit(0.3))


def multi_part(text: Column) -> tuple[Column, Column]:
    t = F.lower(text)
    marks, matched = F.regexp_count(text, F.lit(r"\?")), hits(t, MULTI_PART)
    joins = F.regexp_count(t, F.lit(r",\s*(and|or)\s+"))
    parts = F.greatest(marks, matched, F.when(joins > 0, joins + 1).otherwise(1))
    multi = (parts > 1) | (matched > 0)
    return multi, F.greatest(parts, F.when(multi, 2).otherwise(1))


def _steps(n: Column, first: int) -> Column:
    """0, .3, .5, .7 and a tenth more for each further one, to 1.  Tenths are counted whole: sums of 0.1 fall short of 0.8 and of thresholds."""
    return F.when(n <= first, 0.0).when(n == first + 1, 0.3).when(n == first + 2, 0.5).when(n == first + 3, 0.7).otherwise(F.least((n - first + 4) / F.lit(10.0), F.lit(1.0)))


def complexity(text: Column, weights: tuple[float, float, float] = (0.3, 0.2, 0.3)) -> Column:
    clauses = 1 + sum((F.regexp_count(text, F.lit("(?i)" + ascii_bounds(p))) for p in CLAUSES), F.lit(0))
    length = F.least(F.length(F.trim(text)) / 500.0, F.lit(1.0))
    total = weights[0] * _steps(clauses, 1) + weights[1] * length + weights[2] * _steps(hits(text, MODIFIERS, True), 0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def routing_strategy(intent: Column, score: Column, text: Column, threshold: float = 0.6) -> Column:
    multi, parts = multi_part(text)
    hard = score >= threshold
    return (
        F.when(intent == "conversational", "no_retrieval")
        .when(intent == "clarification", F.when(hard, "complex").otherwise("simple"))
        .when(intent == "analytical", F.when(multi | hard, "complex").otherwise("simple"))
        .when(multi & (parts > 1), "complex")
        .when(hard, "complex")
        .otherwise("simple")
    )


def multi_hop_type(text: Column) -> Column:
    return (
        F.when(any_match(text, COMPARISON), "comparison").when(any_match(text, AGGREGATION), "aggregation").when(any_match(text, SEQUENTIAL), "sequential").when(any_match(text, MULTI_ENTITY), "comparison")
    )


def workflow_strategy(text: Column) -> Column:
    t = F.trim(F.lower(text))
    hop = multi_hop_type(t)
    return F.when(hop == "sequential", "multi_hop").when(hop.isNotNull(), hop).when(any_match(t, COMPLEX), "complex").when(any_match(t, SMALL_TALK), "no_retrieval").otherwise("simple")


def strategy_score(strategy: Column) -> Column:
    out = F.lit(0.25)
    for name, value in STRATEGY_COMPLEXITY.items():
        out = F.when(strategy == name, value).otherwise(out)
    return out


def model_tier(tenant_tier: Column, hardness: Column, intent: Column) -> Column:
    base = F.lit("small")
    for (tier, level), model in MODEL_TIERS.items():
        base = F.when((F.lower(tenant_tier) == tier) & (F.lower(hardness) == level), model).otherwise(base)
    up = (F.upper(intent) == "ANALYTICAL") & (F.lower(tenant_tier) != "basic")
    return F.when(up & (base == "small"), "medium").when(up & (base == "medium"), "large").otherwise(base)


def rerank_needed(override: Column, strategy: Column, intent: Column, score: Column) -> Column:
    hard = strategy.isin("complex", "multi_hop", "comparison", "aggregation")
    return F.coalesce(override, hard | (F.lower(intent) == "analytical") | (score >= 0.75))


def may_hold(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes: a sign that all matches of the pattern hold."""
    if kind == "EMAIL_ADDRESS":
        return F.contains(text, F.lit("@"))
    if kind == "MEDICAL_RECORD":
        return F.contains(text, F.lit("MR")) | F.contains(text, F.lit("Medical Record"))
    return text.rlike("[0-9]")


def pii_counts(text: Column) -> dict[str, Column]:
    return {k: F.when(may_hold(text, k), F.regexp_count(text, F.lit(ascii_bounds(p)))).when(text.isNotNull(), 0) for k, p in PII.items()}


def redacted(text: Column) -> Column:
    """Types replaced one after the other, so overlapping finds can't garble each other; texts without a sign of any are left alone."""
    out = text
    for kind, pattern in PII.items():
        out = F.regexp_replace(out, ascii_bounds(pattern), f"[{kind}]")
    return F.when(reduce(or_, (may_hold(text, kind) for kind in PII)), out).otherwise(text)


def without_secrets(text: Column) -> Column:
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask.replace("$", "\\$"))
    return text


def without_credentials(text: Column) -> Column:
    return F.regexp_replace(text, r"(://[^:]*:)[^@]+(@)", "$1***$2")


def harm(text: Column) -> Column:
    """The first matching category and severity as 'category:severity', else null."""
    out = F.lit(None).cast("string")
    for pattern, category, severity in reversed(HARMS):
        out = F.when(text.rlike("(?i)" + ascii_bounds(pattern)), f"{category}:{severity}").otherwise(out)
    return out


def key_terms(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9]+)"), 1)
    useful = F.filter(words, lambda w: ~F.lower(w).isin(*KEY_TERM_STOP_WORDS) & ((F.length(w) >= 5) | (F.length(w) >= 3) & w.rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(useful, F.lower))


def masked(value: Column, kind: DataType, mask: str = "***") -> Column:
    """A nested value whose fields and map entries of sensitive names are masked whole, at any depth."""
    if isinstance(kind, StructType):
        fields = [
            (F.lit(mask) if is_sensitive(f.name) else masked(value[f.name], f.dataType, mask)).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        hidden = F.lit(mask) if isinstance(kind.valueType, StringType) else F.lit(None)
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE_KEYS)), hidden).otherwise(masked(v, kind.valueType, mask)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType, mask))
    return value


def is_sensitive(name: str) -> bool:
    return any(k in name.lower() for k in SENSITIVE_KEYS)


def visibility(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "internal", "tenant").when(t.isin("public", "private", "group", "tenant"), t)


def display_name(source: Column, title: Column, default: str) -> Column:
    name = F.element_at(F.split(source, "/"), -1)
    clean = F.when(name.rlike("^[0-9]+-"), F.regexp_replace(name, "^[0-9]+-", "")).otherwise(name)
    return F.when(source.startswith("uploads/"), clean).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit(default)))


def positive_int(text: Column, default: int) -> Column:
    n = text.try_cast("int")
    return F.when(n > 0, n).otherwise(default)


def modality_text(speech: Column, scene: Column, screen: Column) -> Column:
    def part(label: str, c: Column) -> Column:
        return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"[{label}] "), F.trim(c)))

    return F.concat_ws("\n", part("Speech", speech), part("Visual", scene), part("Text on screen", screen))


def mean_sentence_bytes(text: Column) -> Column:
    pieces = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.?!]*[.?!]|[^.?!]+$)"), 1), lambda x: F.trim(x)), lambda s: F.octet_length(s) > 3)
    total = F.aggregate(pieces, F.lit(0), lambda a, s: a + F.octet_length(s))
    return F.when(F.size(pieces) == 0, 0.0).otherwise(total / F.size(pieces))


def prose_fraction(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    prose = F.filter(lines, lambda x: x.rlike(r"""[.?!")]$"""))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(prose) / F.size(lines))


def is_heading(line: Column) -> Column:
    """Marked, numbered, upper-case or colon-ended heading lines."""
    t = F.trim(line)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    marked = t.rlike(r"^#+\s*[^#\s]")
    numbered = words.between(2, 12) & t.rlike(r"^[0-9]+(\.[0-9]+)*\.*\s") & ~t.rlike(r"[.?!]$")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    shouted = (F.octet_length(t) <= 100) & ~t.endswith(".") & words.between(2, 12) & (F.length(letters) >= 4) & ~letters.rlike(r"[^\p{Lu}]")
    colon = t.endswith(":") & ~t.contains("://") & words.between(1, 10)
    return (t != "") & (marked | numbered | shouted | colon)
