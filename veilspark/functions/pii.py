"""Stage 2: validated personal data. Candidates are found by regex, then tested natively.

Order matters and is fixed: SSN, e-mail, card, IBAN, phone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import let, luhn_ok, mod97, redact_where, rlike_unicode, when_guarded
from veilspark.functions.reference_data import PHONE_PLANS, card_pattern, iban_pattern, phone_national, phone_pattern
from veilspark.functions.rules import PII_RULES

# ---- Fixed values: candidate shapes and markers.
EMAIL_CANDIDATE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IBAN_CANDIDATE = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
PHONE_CANDIDATE = r"\+?\d[\d\s().\-]{7,16}\d"
EMAIL_MARKER = "[REDACTED_EMAIL]"
CARD_MARKER = "[REDACTED_CARD]"
IBAN_MARKER = "[REDACTED_IBAN]"
PHONE_MARKER = "[REDACTED_PHONE]"
# ---- End of fixed values.

# On purpose without the separator after the last digit, which then stays in the text.
CARD_CANDIDATE = r"\b\d(?:[ \-]?\d){12,18}\b"

# Same matches as EMAIL_CANDIDATE, but each run of local-part characters is entered once, so a
# long run without an "@" costs linear and not quadratic time.
_EMAIL_SEARCH = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"

EMAIL_SHAPE = (
    r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@"
    r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"
)
EMAIL_LOCAL_MAX = 64
EMAIL_DOMAIN_MAX = 254


def is_email(hit: Column) -> Column:
    """Dot-separated local part of at most 64 bytes, host labels of 1 to 63 without edge hyphens."""
    local = F.substring_index(hit, "@", 1)
    domain = F.substring_index(hit, "@", -1)
    sized = (F.octet_length(local) <= EMAIL_LOCAL_MAX) & (F.octet_length(domain) <= EMAIL_DOMAIN_MAX)
    return F.when(sized, hit.rlike(EMAIL_SHAPE)).otherwise(False)


def is_card(hit: Column) -> Column:
    """Known issuer with a length of its own, and a valid Luhn sum."""
    return let(
        F.regexp_replace(hit, "[ -]", ""),
        lambda d: F.when(d.rlike(card_pattern()), luhn_ok(d)).otherwise(False),
    )


def is_iban(hit: Column) -> Column:
    """Known country, its account structure, and remainder 1 modulo 97."""
    return F.when(hit.rlike(iban_pattern()), mod97(hit) == 1).otherwise(False)


def _of_region(value: Callable[[str], str]) -> Column:
    """A constant map from each region with a plan."""
    return F.create_map(*(F.lit(x) for name in PHONE_PLANS for x in (name, value(name))))


def is_phone(hit: Column, region: str | Column) -> Column:
    """A number of a known plan; without a country code it must belong to ``region``.

    A region given as text must have a plan; in a column, a region without one matches international numbers only.
    """
    number = F.concat(
        F.when(hit.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(hit, "[^0-9]", "")
    )

    def test(n: Column) -> Column:
        if isinstance(region, str):
            return n.rlike(phone_pattern(region))
        # The plan of the row's region is looked up, so the expression does not grow with the regions.
        own = F.try_element_at(_of_region(lambda name: f"^(?:{phone_national(name)})$"), region)
        dial_out = F.try_element_at(_of_region(lambda name: PHONE_PLANS[name].dial_out), region)
        beyond = F.when(n.startswith(dial_out), F.concat(F.lit("+"), F.substr(n, F.char_length(dial_out) + 1))).otherwise(n)
        return beyond.rlike(phone_pattern(None)) | F.coalesce(F.rlike(n, own), F.lit(False))

    return let(number, test)


def redact_email(text: Column) -> Column:
    return when_guarded(
        text, lambda v: v.contains("@"), lambda v: redact_where(v, _EMAIL_SEARCH, is_email, EMAIL_MARKER)
    )


def _has_card_digits(v: Column) -> Column:
    return rlike_unicode(v, r"\d(?:[ \-]?\d){12}")


def _has_iban_body(v: Column) -> Column:
    return v.rlike(r"[0-9]{2}[A-Z0-9]{10}")


def _has_phone_digits(v: Column) -> Column:
    return rlike_unicode(v, r"\d[\d\s().\-]{7,16}\d")


def redact_card(text: Column) -> Column:
    return when_guarded(
        text, _has_card_digits, lambda v: redact_where(v, "(?U)" + CARD_CANDIDATE, is_card, CARD_MARKER)
    )


def redact_iban(text: Column) -> Column:
    return when_guarded(
        text, _has_iban_body, lambda v: redact_where(v, "(?U)" + IBAN_CANDIDATE, is_iban, IBAN_MARKER)
    )


def redact_phone(text: Column, region: str | Column = "FR") -> Column:
    return when_guarded(
        text,
        _has_phone_digits,
        lambda v: redact_where(
            v, "(?U)" + PHONE_CANDIDATE, lambda hit: is_phone(hit, region), PHONE_MARKER
        ),
    )


def redact_ssn(text: Column) -> Column:
    for r in PII_RULES:
        text = r.apply(text)
    return text


def redact_pii(text: Column, region: str | Column = "FR") -> Column:
    """SSN, e-mail, card, IBAN and phone numbers.

    Every SSN and every card candidate contains a phone-shaped stretch of digits, so one
    scan for that shape stands for all three.
    """
    return when_guarded(
        text,
        lambda v: v.contains("@") | _has_phone_digits(v) | _has_iban_body(v),
        lambda v: redact_phone(redact_iban(redact_card(redact_email(redact_ssn(v)))), region),
    )
