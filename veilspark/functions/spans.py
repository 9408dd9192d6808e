"""Where in the raw text each rule fires.

Every rule of the chain runs on a working copy in which a hit is replaced by a stand-in of its own length, a first
and some further characters of the private use area that tell the rule. Like a marker, a stand-in is no word, digit,
space or quote, so later rules do with it what they do with a marker, and one scan at the end reads all places off.
Only terminal codes shorten the copy; their lengths are added back to the places found behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import pii as P
from veilspark.functions.core import let, replace_where, when_guarded
from veilspark.functions.rules import HIGH_ENTROPY_CANDIDATE, NORMALIZE_RULES, PII_RULES, STAGE1_RULES, Rule
from veilspark.functions.secrets import has_wide_piece, is_high_entropy

#: What a rule leaves in front of the stand-in and behind it; of other rules the stand-in takes the whole hit.
KEPT: dict[str, tuple[str, str]] = {
    "aws_secret": ("$1", ""),
    "json_secret": ("$1", ""),
    "kv_secret": ("$1=", ""),
    "db_uri": ("$1://$2:", "@"),
}
SPAN_RULES: tuple[str, ...] = (
    *(r.name for r in STAGE1_RULES[1:]), "high_entropy", *(r.name for r in NORMALIZE_RULES),
    *(r.name for r in PII_RULES), "email", "card", "iban", "phone",
)
FIRST, FURTHER, FOREIGN = 0xE000, 0xE080, 0xF000

_ANSI = STAGE1_RULES[0]
_STAND_IN = f"[{chr(FIRST)}-{chr(FURTHER - 1)}][{chr(FURTHER)}-{chr(FURTHER + 127)}]*+"
_OWN = f"[{chr(FIRST)}-{chr(FURTHER + 127)}]"
_BLOCK = 256


def running(values: Column) -> Column:
    """Sums of all values before each one; by blocks, as appending to one array is quadratic in its length."""

    def before(v: Column, start: Column) -> Column:
        none = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            v, none, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all"))
        )["all"]

    def body(v: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        count = F.ceil(F.size(v) / _BLOCK).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

        def joined(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
            return F.flatten(F.zip_with(blocks, before(sums, zero), before))

        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(cuts, joined))

    return let(F.transform(values, lambda x: x.cast("bigint")), body)


def _stand_in(hit: Column, name: str) -> Column:
    k = SPAN_RULES.index(name)
    return F.concat(F.lit(chr(FIRST + k)), F.repeat(F.lit(chr(FURTHER + k)), F.char_length(hit) - 1))


def _rule(text: Column, r: Rule) -> Column:
    front, back = KEPT.get(r.name, ("", ""))

    def render(hit: Column) -> Column:
        if not front:
            return _stand_in(hit, r.name)

        def split(kept: Column) -> Column:
            value = F.substring(hit, F.char_length(kept) + 1, F.char_length(hit) - F.char_length(kept) - len(back))
            return F.concat(kept, _stand_in(value, r.name), F.lit(back))

        return let(F.regexp_replace(hit, r.java_pattern, front), split)

    def rewrite(v: Column) -> Column:
        return replace_where(v, r.java_pattern, render)

    return when_guarded(text, r.possible, rewrite) if r.needs or r.needs_folded else rewrite(text)


def _tested(text: Column, guard: Callable, pattern: str, test: Callable, name: str) -> Column:
    def render(hit: Column) -> Column:
        return F.when(test(hit), _stand_in(hit, name)).otherwise(hit)

    return when_guarded(text, guard, lambda v: replace_where(v, pattern, render))


def _secrets(text: Column, rules: tuple[Rule, ...]) -> Column:
    for r in rules:
        text = _rule(text, r)
    return text


def _values(text: Column) -> Column:
    text = _tested(text, has_wide_piece, HIGH_ENTROPY_CANDIDATE, is_high_entropy, "high_entropy")
    return _secrets(text, (*NORMALIZE_RULES, *PII_RULES))


def _personal(text: Column, region: str | Column) -> Column:
    text = _tested(text, lambda v: v.contains("@"), P._EMAIL_SEARCH, P.is_email, "email")
    text = _tested(text, P._has_card_digits, "(?U)" + P.CARD_CANDIDATE, P.is_card, "card")
    text = _tested(text, P._has_iban_body, "(?U)" + P.IBAN_CANDIDATE, P.is_iban, "iban")
    return _tested(text, P._has_phone_digits, "(?U)" + P.PHONE_CANDIDATE, lambda h: P.is_phone(h, region), "phone")


def _copied(raw: Column) -> Column:
    """The working copy: characters that look like a stand-in become another one, terminal codes go."""
    return _ANSI.apply(when_guarded(raw, lambda v: v.rlike(_OWN), lambda v: F.regexp_replace(v, _OWN, chr(FOREIGN))))


def _places(marked: Column) -> Column:
    """Stand-ins of the working copy as (rule, start, end)."""

    def body(v: Column) -> Column:
        gaps, hits = F.split(v, _STAND_IN, -1), F.regexp_extract_all(v, F.lit(_STAND_IN), F.lit(0))

        def at(pieces: Column) -> Column:
            offsets = running(F.transform(pieces, lambda p: F.char_length(p["gap"]) + F.char_length(p["hit"])))
            return F.zip_with(pieces, offsets, lambda p, before: let(
                before + F.char_length(p["gap"]),
                lambda start: F.struct(
                    F.get(F.lit(list(SPAN_RULES)), F.ascii(p["hit"]) - FIRST).alias("rule"),
                    start.alias("start"),
                    (start + F.char_length(p["hit"])).alias("end"),
                ),
            ))

        # The gap behind the last hit has no hit to go with.
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return let(pairs, at)

    return let(marked, body)


def _behind_codes(found: Column, raw: Column) -> Column:
    """Places in the text without terminal codes as places in the raw text.

    Ends, codes and starts are sorted by place, in this order where they meet, and the codes' lengths summed along.
    """

    def event(place: Column, kind: int, length: Column, i: Column) -> Column:
        return F.struct(
            place.cast("bigint").alias("place"), F.lit(kind).alias("kind"), i.cast("int").alias("i"),
            length.cast("bigint").alias("length"),
        )

    zero = F.lit(0)

    def body(pieces: Column) -> Column:
        gaps, codes = pieces["gaps"], pieces["codes"]
        ahead = running(F.transform(gaps, F.char_length))
        events = F.concat(
            F.transform(codes, lambda c, i: event(F.get(ahead, i + 1), 1, F.char_length(c), i)),
            F.transform(found, lambda f, i: event(f["start"], 2, zero, i)),
            F.transform(found, lambda f, i: event(f["end"], 0, zero, i)),
        )

        def shifted(e: Column) -> Column:
            sums = running(F.transform(e, lambda x: x["length"]))
            moved = F.zip_with(e, sums, lambda x, s: F.struct(x["kind"].alias("kind"), x["i"].alias("i"), (x["place"] + s).alias("p")))
            # Hits do not overlap, so starts and ends come in the order of the hits.
            ends, starts = F.filter(moved, lambda m: m["kind"] == 0), F.filter(moved, lambda m: m["kind"] == 2)
            return F.zip_with(
                F.zip_with(found, starts, lambda f, m: F.struct(f["rule"].alias("rule"), m["p"].alias("start"))),
                ends,
                lambda f, m: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), m["p"].alias("end")),
            )

        return let(F.sort_array(events), shifted)

    pattern = _ANSI.java_pattern
    both = F.struct(F.split(raw, pattern, -1).alias("gaps"), F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)).alias("codes"))
    return let(both, body)


def spans_table(df: DataFrame, keys: list[str], text: str = "text", region: str | Column = "FR") -> DataFrame:
    """(keys, rule, span_start, span_end): one row per finding, characters from 0 in the raw text, end excluded.

    All secret, value and personal data rules count, before lines are pruned or collapsed. A place is what the rule
    masks: the value only, where it keeps a key or an address. Hits that a later rule masks as a whole are left out,
    and so are markers that the raw text itself holds. A null or empty text has none; repeated rows give their
    findings each. Everything happens in the row: nothing is shuffled.

    The chain is cut into several columns, as Spark resolves nested lambdas one level at a time.
    """
    where = F.lit(region) if isinstance(region, str) else region
    read = df.select(*keys, F.col(text).alias("_span_raw"), where.alias("_span_region"))
    steps = [
        _copied,
        *(lambda v, i=i: _secrets(v, STAGE1_RULES[i : i + 5]) for i in range(1, len(STAGE1_RULES), 5)),
        _values,
        lambda v: _personal(v, region if isinstance(region, str) else F.col("_span_region")),
        _places,
    ]
    marked = read.withColumn("_span_at", F.col("_span_raw"))
    for step in steps:
        marked = marked.withColumn("_span_at", step(F.col("_span_at")))
    raw = F.col("_span_raw")
    places = let(
        F.col("_span_at"),
        lambda f: F.when(raw.contains("\x1b[") & (F.size(f) > 0), _behind_codes(f, raw)).otherwise(f),
    )
    found = marked.select(*keys, F.explode(places).alias("_span"))
    return found.select(
        *keys, "_span.rule", F.col("_span.start").alias("span_start"), F.col("_span.end").alias("span_end")
    )
