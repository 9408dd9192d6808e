"""The ordered registry of plain redaction and normalization rules.

A rule is data: what it matches, what it writes, and literals without which it cannot match.
Order is part of the result: a later rule may rewrite the marker of an earlier one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import contains_any, let


@dataclass(frozen=True)
class Rule:
    """One regex rule.

    ``pattern`` is written in the dialect that Java and RE2 share; ``replacement`` uses ``$1``.
    ``needs`` is a conjunction of "one of these literals occurs"; ``needs_folded`` are literals that all
    occur in the lower-cased text, for rules that ignore case, and ``needs_some_folded`` some of which one does.
    Folded literals avoid ``s`` and ``i``, which have case partners that lowering leaves (the Kelvin sign becomes ``k``).  ``width`` is a length in characters that
    some piece of the text without a blank or newline must have.
    """

    name: str
    pattern: str
    replacement: str
    ignore_case: bool = False
    needs: tuple[tuple[str, ...], ...] = ()
    needs_folded: tuple[str, ...] = ()
    needs_some_folded: tuple[str, ...] = ()
    width: int = 0

    @property
    def java_pattern(self) -> str:
        """Unicode classes, boundaries and case folding where the pattern depends on them."""
        if self.ignore_case:
            return "(?iU)" + self.pattern
        if any(cls in self.pattern for cls in (r"\d", r"\s", r"\b", r"\w")):
            return "(?U)" + self.pattern
        return self.pattern

    def possible(self, text: Column) -> Column:
        """A cheap necessary condition for the rule to match."""
        tests = [contains_any(text, group) for group in self.needs]
        tests += [F.lower(text).contains(literal) for literal in self.needs_folded]
        if self.needs_some_folded:
            tests.append(let(F.lower(text), lambda folded: contains_any(folded, self.needs_some_folded)))
        return reduce(Column.__and__, tests)

    def rewrite(self, text: Column) -> Column:
        return F.regexp_replace(text, self.java_pattern, self.replacement)

    def step(self, text: Column) -> Column:
        """The rule behind its guard; names ``text`` several times, so that must be cheap (see ``let``)."""
        if not self.needs and not self.needs_folded:
            return self.rewrite(text)
        return F.when(self.possible(text), self.rewrite(text)).otherwise(text)

    def apply(self, text: Column) -> Column:
        return let(text, self.step)


# ---- Fixed values: patterns, markers and their order must equal those of the engine whose
# ---- results are matched.  ``needs``, ``needs_folded`` and ``width`` are ours.
STAGE1_RULES: tuple[Rule, ...] = (
    Rule("ansi", r"\x1b\[[0-9;?]*[a-zA-Z]", "", needs=(("\x1b[",),)),
    Rule(
        "private_key",
        r"-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP|PRIVATE)? KEY-----[\s\S]*?-----END (?:RSA|DSA|EC|OPENSSH|PGP|PRIVATE)? KEY-----",
        "[REDACTED_PRIVATE_KEY]",
        needs=(("-----BEGIN ",), ("-----END ",)),
    ),
    Rule(
        "openai_key",
        r"sk-(?:proj-|admin-|svc-|[a-zA-Z0-9]{20,})[a-zA-Z0-9_\-]{20,}",
        "[REDACTED_OPENAI_KEY]",
        needs=(("sk-",),),
        width=27,
    ),
    Rule(
        "aws_key",
        r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}",
        "[REDACTED_AWS_KEY]",
        needs=(("AKIA", "ASIA", "ABIA", "ACCA"),),
        width=20,
    ),
    Rule(
        "aws_secret",
        r"""(aws_secret_access_key|aws_secret|secret_key)\s*[:=]\s*['"]?([A-Za-z0-9/+=]{40})['"]?""",
        '$1: "[REDACTED_AWS_SECRET]"',
        ignore_case=True,
        needs=(("_",), (":", "=")),
        needs_folded=("ecret",),
        width=40,
    ),
    Rule(
        "github_token",
        r"(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{20,80}",
        "[REDACTED_GITHUB_TOKEN]",
        needs=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),),
        width=31,
    ),
    Rule(
        "bearer",
        r"Bearer\s+[a-zA-Z0-9\-_~+/]{20,}=*",
        "Bearer [REDACTED_BEARER_TOKEN]",
        ignore_case=True,
        needs_folded=("bearer",),
        width=20,
    ),
    Rule(
        "slack_webhook",
        r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+",
        "[REDACTED_SLACK_WEBHOOK]",
        needs=(("https://hooks.slack.com/services/T",),),
        width=40,
    ),
    Rule("slack_token", r"xox[baprs]-[0-9a-zA-Z\-]{10,72}", "[REDACTED_SLACK_TOKEN]", needs=(("xox",),), width=15),
    Rule(
        "stripe_key",
        r"(?:sk|rk)_(?:live|test)_[0-9a-zA-Z]{20,247}",
        "[REDACTED_STRIPE_KEY]",
        needs=(("k_live_", "k_test_"),),
        width=28,
    ),
    Rule("twilio_key", r"SK[0-9a-fA-F]{32}", "[REDACTED_TWILIO_KEY]", needs=(("SK",),), width=34),
    Rule(
        "sendgrid_key",
        r"SG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}",
        "[REDACTED_SENDGRID_KEY]",
        needs=(("SG.",),),
        width=69,
    ),
    Rule("google_api_key", r"AIza[0-9A-Za-z_\-]{35}", "[REDACTED_GOOGLE_API_KEY]", needs=(("AIza",),), width=39),
    Rule("npm_token", r"npm_[a-zA-Z0-9]{36}", "[REDACTED_NPM_TOKEN]", needs=(("npm_",),), width=40),
    Rule(
        "azure_conn",
        r"DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[a-zA-Z0-9+/=]{20,}",
        "[REDACTED_AZURE_CONN_STRING]",
        ignore_case=True,
        needs_folded=(";accountname=",),
        width=31,
    ),
    Rule(
        "json_secret",
        r"""("(?:api[_-]?key|secret|password|passwd|auth[_-]?token|private[_-]?key|access[_-]?token)"\s*:\s*)"[^"]{8,}\"""",
        '$1"[REDACTED_SECRET]"',
        ignore_case=True,
        needs=(('"',), (":",)),
        needs_some_folded=('key"', 'ecret"', 'word"', 'wd"', 'oken"'),
    ),
    Rule(
        "kv_secret",
        r"""\b(api[_-]?key|secret|password|passwd|auth[_-]?token|access[_-]?token)=['"]?[a-zA-Z0-9_\-.~+/@]{8,}['"]?""",
        "$1=[REDACTED_SECRET]",
        ignore_case=True,
        needs=(("=",),),
        needs_some_folded=("key=", "ecret=", "word=", "wd=", "oken="),
    ),
    Rule(
        "db_uri",
        r"(postgres|postgresql|mysql|mongodb|mongodb\+srv|redis)://([^:\s]+):([^@\s]+)@",
        "$1://$2:[REDACTED_PASS]@",
        ignore_case=True,
        needs=(("://",), ("@",)),
    ),
    Rule(
        "base64_image",
        r"data:image/[a-zA-Z0-9\+\-]+;base64,[a-zA-Z0-9+/=]{30,}",
        "<BASE64_DATA truncated>",
        needs=(("data:image/",), (";base64,",)),
        width=50,
    ),
    Rule(
        "jwt",
        r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}",
        "<JWT truncated>",
        needs=((".eyJ",),),
        width=38,
    ),
)

# Runs after the high-entropy pass.
NORMALIZE_RULES: tuple[Rule, ...] = (
    Rule(
        "iso_time",
        r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
        "<TIME>",
        needs=((":",), ("-",)),
    ),
    Rule("time_only", r"\b\d{2}:\d{2}:\d{2}(?:\.\d{3,6})?\b", "<TIME>", needs=((":",),)),
    Rule("hex_addr", r"0x[0-9a-fA-F]{8,16}\b", "<ADDR>", needs=(("0x",),)),
)

PII_RULES: tuple[Rule, ...] = (
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]", needs=(("-",),)),
)

HIGH_ENTROPY_CANDIDATE = r"[A-Za-z0-9+/=_\-]{24,}"
HIGH_ENTROPY_BITS = 4.0
HIGH_ENTROPY_MARKER = "[REDACTED_HIGH_ENTROPY]"

# Markers as they show up in clean text, with the rule that wrote each.
MARKERS: dict[str, str] = {
    "[REDACTED_PRIVATE_KEY]": "private_key",
    "[REDACTED_OPENAI_KEY]": "openai_key",
    "[REDACTED_AWS_KEY]": "aws_key",
    "[REDACTED_AWS_SECRET]": "aws_secret",
    "[REDACTED_GITHUB_TOKEN]": "github_token",
    "[REDACTED_BEARER_TOKEN]": "bearer",
    "[REDACTED_SLACK_WEBHOOK]": "slack_webhook",
    "[REDACTED_SLACK_TOKEN]": "slack_token",
    "[REDACTED_STRIPE_KEY]": "stripe_key",
    "[REDACTED_TWILIO_KEY]": "twilio_key",
    "[REDACTED_SENDGRID_KEY]": "sendgrid_key",
    "[REDACTED_GOOGLE_API_KEY]": "google_api_key",
    "[REDACTED_NPM_TOKEN]": "npm_token",
    "[REDACTED_AZURE_CONN_STRING]": "azure_conn",
    "[REDACTED_SECRET]": "secret",
    "[REDACTED_PASS]": "db_uri",
    "<BASE64_DATA truncated>": "base64_image",
    "<JWT truncated>": "jwt",
    "[REDACTED_HIGH_ENTROPY]": "high_entropy",
    "<TIME>": "time",
    "<ADDR>": "hex_addr",
    "[REDACTED_SSN]": "ssn",
    "[REDACTED_EMAIL]": "email",
    "[REDACTED_CARD]": "card",
    "[REDACTED_IBAN]": "iban",
    "[REDACTED_PHONE]": "phone",
}
# ---- End of fixed values.

# Rules of at least this width are skipped together where no piece of the text is that long.
WIDE_PIECE = 20

ALL_RULES: tuple[Rule, ...] = STAGE1_RULES + NORMALIZE_RULES + PII_RULES


def rule(name: str) -> Rule:
    return next(r for r in ALL_RULES if r.name == name)


def apply_rule(text: Column, name: str) -> Column:
    """One rule on its own, for example ``apply_rule(F.col("text"), "jwt")``."""
    return rule(name).apply(text)


def rules_table(spark):
    """The registry as a small DataFrame: pos, name, pattern, replacement."""
    rows = [(i, r.name, r.java_pattern, r.replacement) for i, r in enumerate(ALL_RULES, 1)]
    return spark.createDataFrame(rows, "pos int, name string, pattern string, replacement string")
