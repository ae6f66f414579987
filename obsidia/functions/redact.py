"""Redaction, templates and classification of text, as expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and what stands in their place, applied in this order.
PATTERNS = [
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    (r"([0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}", "[IPV6]"),
    (r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", "[JWT]"),
    (r"""(?i)(api[_-]?key|apikey|api_secret|secret_key|access_token|auth_token|private_key)[=:\s]["']?([a-zA-Z0-9_\-]{16,})["']?""", "$1=[REDACTED]"),
    (r"(?i)bearer\s+[a-zA-Z0-9_\-\.]{20,}", "Bearer [TOKEN]"),
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    (r"""(?i)(aws_secret_access_key|secret_access_key)[=:\s]["']?([a-zA-Z0-9/+=]{40})["']?""", "$1=[REDACTED]"),
    (r"\b(?:\d[ \-]*?){13,19}\b", "[CARD]"),
    (r"\b\+?1?[\-.\s]?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b", "[SSN]"),
    (r"://([^:]+):([^@]+)@", "://[USER]:[PASS]@"),
    (r"""(?i)(password|passwd|pwd)[=:\s]["']?([^\s"']{4,})["']?""", "$1=[REDACTED]"),
    (r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+ PRIVATE KEY-----", "[PRIVATE_KEY]"),
    (r"xox[baprs]-[0-9a-zA-Z\-]{10,}", "[SLACK_TOKEN]"),
    (r"ghp_[a-zA-Z0-9]{36}", "[GITHUB_TOKEN]"),
    (r"sk_(live|test)_[a-zA-Z0-9]{24,}", "[STRIPE_KEY]"),
]
UUID = (r"([0-9a-fA-F]{8})-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "$1-****-****-****-************")
NUMERIC_ID = (r"\b\d{5,}\b", "[ID]")
PATH = [
    (r"/\d+(/|$)", "/[ID]$1"),
    (r"/[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(/|$)", "/[UUID]$2"),
    (r"/[a-zA-Z0-9_-]{20,}(/|$)", "/[TOKEN]$1"),
]
# Keys whose values are not shown.
SENSITIVE_KEYS = ["user_id", "userId", "customer_id", "customerId", "email", "phone", "address", "ssn", "token", "api_key", "apiKey", "secret", "password", "auth", "authorization"]
# The first type that has a phrase in the message, in this order.
ERROR_TYPES = [
    ("timeout", ["timeout", "timed out", "deadline exceeded"]),
    ("connection_error", ["connection refused", "connection reset", "no route to host", "network unreachable"]),
    ("dns_error", ["dns", "no such host", "name resolution"]),
    ("tls_error", ["tls", "ssl", "certificate"]),
    ("memory_error", ["out of memory", "oom", "memory limit"]),
    ("database_error", ["database", "sql", "query failed", "connection pool"]),
    ("auth_error", ["unauthorized", "forbidden", "authentication", "permission denied"]),
    ("rate_limit", ["rate limit", "too many requests", "throttl"]),
    ("server_error", ["internal server error", "500"]),
    ("validation_error", ["bad request", "invalid", "malformed"]),
]


def fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, *map(F.lit, rule)), rules, text)


#: What a text must hold for each of PATTERNS to find anything in it: one of these strings, in lower case where the pattern reads both
#: cases; a digit; or nothing in particular. No replacement brings in what a later pattern needs.
_DIGIT = "0123456789"
_NEEDS: list[tuple[str, list[str]]] = [
    ("has", ["@"]), ("digit", []), ("has", [":"]), ("has", ["eyJ"]), ("lower", ["api", "secret_key", "access_token", "auth_token", "private_key"]), ("lower", ["bearer"]), ("has", ["AKIA"]),
    ("lower", ["secret_access_key"]), ("digit", []), ("digit", []), ("digit", []), ("has", ["://"]), ("lower", ["passw", "pwd"]), ("has", ["-----BEGIN"]), ("has", ["xox"]), ("has", ["ghp_"]), ("has", ["sk_"]),
]


def _guarded(text: Column, rules: list[tuple[tuple[str, str], tuple[str, list[str]]]]) -> Column:
    """fold, but a pattern is only looked for in texts that hold what it needs, which is cheaper to see."""
    has = {"has": lambda s, x: s["t"].contains(x), "lower": lambda s, x: s["low"].contains(x)}

    def stepped(rule: tuple[str, str], need: tuple[str, list[str]]):
        kind, strings = need

        def step(s: Column) -> Column:
            there = s["digit"] if kind == "digit" else reduce(lambda a, b: a | b, [has[kind](s, x) for x in strings])
            out = F.when(there, F.regexp_replace(s["out"], F.lit(rule[0]), F.lit(rule[1]))).otherwise(s["out"])
            return F.struct(s["t"].alias("t"), s["low"].alias("low"), s["digit"].alias("digit"), out.alias("out"))

        return step

    state = F.struct(text.alias("t"), F.lower(text).alias("low"), (F.translate(text, _DIGIT, "") != text).alias("digit"), text.alias("out"))
    for rule, need in rules:
        state = F.get(F.transform(F.array(state), stepped(rule, need)), F.lit(0))
    return state["out"]


def redact(text: Column) -> Column:
    """Personal data and secrets in the text are named instead of shown. Null stays null."""
    return _guarded(text, list(zip(PATTERNS, _NEEDS, strict=True)))


def redact_uuid(text: Column) -> Column:
    """A UUID keeps its first eight digits."""
    return fold(text, [UUID])


def template(text: Column) -> Column:
    """What a message has in common with others of its kind: redacted, without long numbers."""
    return fold(redact(text), [UUID, NUMERIC_ID])


def short_hash(text: Column) -> Column:
    """The first 8 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 16)


def redact_path(path: Column) -> Column:
    """Numbers, UUIDs and long tokens in a path. A match takes the slash behind it, so of numbers in a row every other one is replaced."""
    return fold(path, PATH)


def redact_pairs(text: Column) -> Column:
    """Values of sensitive keys in JSON and in key=value form, then everything that redact knows."""
    rules = [r for k in SENSITIVE_KEYS for r in ((f'"{k}"\\s*:\\s*"[^"]*"', f'"{k}":"[REDACTED]"'), (f"(?i){k}=([^\\s&]+)", f"{k}=[REDACTED]"))]
    return redact(fold(text, rules))


def redact_env(env: Column) -> Column:
    """Of a map: values of keys that sound secret, and values of over 20 characters without a space."""
    secret = ["password", "secret", "token", "key", "credential", "auth"]  # fixed values

    def value(k: Column, v: Column) -> Column:
        named = reduce(lambda a, b: a | b, [F.lower(k).contains(s) for s in secret])
        return F.when(named | ((F.length(v) > 20) & ~v.contains(" ")), "[REDACTED]").otherwise(v)

    return F.transform_values(env, value)


def error_type(message: Column) -> Column:
    lower = F.lower(message)
    out: Column = F
    for name, phrases in ERROR_TYPES:
        out = out.when(reduce(lambda a, b: a | b, [lower.contains(p) for p in phrases]), name)
    return out.otherwise("unknown")


def namespace(service: Column) -> Column:
    """A guess from a service's name."""
    there = lambda s: service.contains(f"-{s}") | service.contains(f"{s}-")
    return F.when(there("prod"), "production").when(there("staging"), "staging").otherwise("default")
