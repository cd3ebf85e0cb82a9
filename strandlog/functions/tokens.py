"""Tokenisers and token classes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters, word lists and shapes that decide tokens and classes.
FRAGMENT_DELIMITERS = r"""://|[\s'";=()\[\]{}?@&<>:,]|\.(?:\s+|$)|\\["']"""
SEMANTIC_DELIMITERS = r"""://|(?:[\s'`";=()\[\]{}?@&<>:,]|\.(?:\s+|$)|\\["'])+"""
CHAR_CLASSES = r"[0-9]+|[A-Za-z]+|\s+|[^0-9A-Za-z\s]+"
SERVICES = ("sshd", "kernel", "cups", "ftpd", "su", "gpm", "systemd", "pam_unix", "cron", "nginx", "apache", "mysql", "postgres")
ACTIONS = ("authentication", "failure", "success", "opened", "closed", "started", "stopped", "connected", "disconnected", "failed", "session", "connection", "registered", "unregistered")
FIELDS = ("uid", "euid", "tty", "ruser", "rhost", "logname", "pid", "user", "from", "to", "port", "status")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEMANTIC_KEYWORDS = ("authentication", "failure", "success", "opened", "closed", "sshd", "kernel", "cups", "ftpd", "su", "gpm", "pam_unix", "session", "connection", "from", "for", "uid", "euid", "tty", "ruser", "rhost", "user", "logname", "INFO", "ERROR", "WARN", "DEBUG")
EPHEMERAL = (
    r"^\p{N}*$", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "::", r":[^:]*:[^:]*:", r"^\d{2}:\d{2}:\d{2}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$",
    f"^(?:{'|'.join(MONTHS)})$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "^0x", r"^[0-9A-Fa-f]{9,}$",
)
CONTEXT_HINTS = (("user", ("user", "uid", "login")), ("resource", ("file", "path", "table")), ("action", ("status", "code", "result")), ("location", ("host", "server")))
USER_HINTS = ("root", "admin", "guest")
FRAGMENT_TYPES = ("timestamp", "hostname", "service", "pid", "number", "ip_address", "path", "hex", "uuid", "url", "static_text")

STATIC, EPHEMERAL_CLASS = "static", "ephemeral"


def _split(text: Column, delimiters: str) -> Column:
    return F.filter(F.split(text, delimiters, -1), lambda x: x != "")


def tokenize_fragments(line: Column) -> Column:
    return _split(line, FRAGMENT_DELIMITERS)


def tokenize_semantic(line: Column) -> Column:
    """Runs of delimiters part tokens; a backtick is a delimiter too."""
    return _split(line, SEMANTIC_DELIMITERS)


def char_class_tokens(line: Column) -> Column:
    """Runs of digits, letters, white space and other characters."""
    return F.regexp_extract_all(line, F.lit(CHAR_CLASSES), F.lit(0))


def _any_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def is_static(token: Column) -> Column:
    low = F.lower(token)
    return low.rlike(_any_of(SERVICES + ACTIONS)) | low.rlike(f"^{_any_of(FIELDS)}=?$") | (token == "")


def is_ephemeral(token: Column) -> Column:
    out = F.lit(False)
    for shape in EPHEMERAL:
        out = out | token.rlike(shape)
    return out


def parameter_type(token: Column, context: Column | None = None) -> Column:
    """user, resource, action, location or generic: by the context's hints first, then by the token."""
    rules = []
    if context is not None:
        low = F.coalesce(F.lower(context), F.lit(""))
        rules += [(low.rlike(_any_of(hints)), kind) for kind, hints in CONTEXT_HINTS]
    rules += [
        (F.lower(token).rlike(_any_of(USER_HINTS)), "user"),
        (token.contains(".") & token.rlike(r"\p{L}"), "location"),
        (token.startswith("/"), "resource"),
        (token.rlike("^(?:ERR|OK)") | token.isin("200", "404", "500"), "action"),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("generic")


def classify_token(token: Column, context: Column | None = None) -> Column:
    """static, ephemeral, or a parameter's type."""
    return F.when(is_static(token), STATIC).when(is_ephemeral(token), EPHEMERAL_CLASS).otherwise(parameter_type(token, context))


def log_type_signature(tokens: Column) -> Column:
    """Level 1: static tokens."""
    return F.array_join(F.filter(tokens, is_static), " ")


def template_signature(tokens: Column) -> Column:
    """Level 2: static tokens, and parameters as ``<Type>``."""
    shown = F.transform(tokens, lambda t: F.struct(t.alias("t"), classify_token(t).alias("c")))
    kept = F.filter(shown, lambda x: x["c"] != EPHEMERAL_CLASS)
    return F.array_join(F.transform(kept, lambda x: F.when(x["c"] == STATIC, x["t"]).otherwise(F.concat(F.lit("<"), F.initcap(x["c"]), F.lit(">")))), " ")


def is_keyword(token: Column) -> Column:
    return token.rlike(_any_of(SEMANTIC_KEYWORDS))


def is_likely_parameter(token: Column) -> Column:
    return (token != "") & (token.rlike(r"\p{N}") | token.rlike(r"[./-]") | (F.octet_length(token) > 2))


def infer_parameter_type(token: Column) -> Column:
    return (F.when(token.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip_address").when(token.contains(".") & token.rlike(r"\p{L}"), "hostname")
            .when(token.rlike(r"^\p{N}*$"), "number").when(token.startswith("/"), "path").when(token.rlike(r"^\d{2}:\d{2}:\d{2}$"), "time")
            .when(token.isin(*MONTHS), "month").otherwise("value"))


def keywords(tokens: Column) -> Column:
    """Static keywords with repeats, in order."""
    return F.filter(tokens, is_keyword)


def parameters(tokens: Column) -> Column:
    """Distinct parameter types in the order they are first seen."""
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: ~is_keyword(t) & is_likely_parameter(t)), infer_parameter_type))


def fragment_type(name: Column) -> Column:
    """A type's name in any case; unknown names are static text."""
    return F.when(F.lower(name).isin(*FRAGMENT_TYPES), F.lower(name)).otherwise("static_text")
