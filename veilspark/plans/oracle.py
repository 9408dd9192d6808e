"""The registered queries in DuckDB SQL, over whole tables.

Line operators, diffs and reports are written as windows, joins and grouping sets, a different
road from the in-row expressions they check.
"""

from __future__ import annotations

from veilspark.functions import pii as P
from veilspark.functions import rewrite as RW
from veilspark.functions.lines import FRAME_PATTERN, INTERNAL_FRAGMENTS, PRUNED_PREFIX, PRUNED_SUFFIX
from veilspark.functions.profanity import SPACED_PATTERN
from veilspark.functions.reference_data import (
    PROFANE_LEXICON,
    card_pattern,
    iban_pattern,
    phone_pattern,
    profane_pattern,
    profane_stem,
)
from veilspark.functions.rules import (
    ALL_RULES,
    HIGH_ENTROPY_BITS,
    HIGH_ENTROPY_CANDIDATE,
    HIGH_ENTROPY_MARKER,
    MARKERS,
    NORMALIZE_RULES,
    STAGE1_RULES,
    Rule,
    rule,
)
from veilspark.functions.skeleton import LOOKALIKES, WORD_PATTERN
from veilspark.functions.spans import FIRST, FURTHER, KEPT, SPAN_RULES
from veilspark.functions.tokens import TOKEN_PATTERN, WORD_FACTOR
from veilspark.plans.corpus import CORPUS_SQL, LOGS_SQL, REPLY_BODY_SQL, REPLY_SQL

K = "corpus, id, part"
NL = "chr(10)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# ---- Scalar expressions -------------------------------------------------------------------


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank_sql(x: str) -> str:
    return rf"NOT regexp_matches({x}, '\S')"


def rule_sql(x: str, r: Rule) -> str:
    pattern = ("(?i)" if r.ignore_case else "") + r.pattern
    replacement = r.replacement.replace("$", "\\")
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"


def rules_sql(x: str, rules) -> str:
    for r in rules:
        x = rule_sql(x, r)
    return x


def replace_where_sql(x: str, pattern: str, render: str) -> str:
    """``render`` is an expression over ``h``, a match; null in, null out."""
    p = q(pattern)
    hits = f"list_transform(regexp_extract_all({x}, {p}), lambda h: {render})"
    return (
        f"CASE WHEN regexp_matches({x}, {p}) THEN array_to_string(list_transform("
        f"list_zip(string_split_regex({x}, {p}), {hits}), lambda z: concat(z[1], z[2])), '') ELSE {x} END"
    )


def redact_where_sql(x: str, pattern: str, test: str, marker: str) -> str:
    return replace_where_sql(x, pattern, f"CASE WHEN {test} THEN {q(marker)} ELSE h END")


def entropy_sql(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE)"
    chars = f"list_distinct(string_split({x}, ''))"
    return (
        f"CASE WHEN {x} = '' THEN 0.0 ELSE "
        f"-list_sum(list_transform({chars}, lambda c: {share} * log2({share}))) END"
    )


def luhn_sql(d: str) -> str:
    digit = f"(ascii(substr({d}, length({d}) - i::INT + 1, 1)) - 48)"
    value = f"CASE WHEN i % 2 = 0 THEN {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: {value})) % 10 = 0"


def mod97_sql(a: str) -> str:
    turned = f"concat(substr({a}, 5), substr({a}, 1, 4))"
    spelled = (
        f"array_to_string(list_transform(string_split({turned}, ''), lambda c: "
        "CASE WHEN ascii(c) < 65 THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"
    )
    steps = f"list_transform(string_split({spelled}, ''), lambda c: c::BIGINT)"
    return f"list_reduce({steps}, lambda acc, n: (acc * 10 + n) % 97, 0::BIGINT) = 1"


ENTROPY = redact_where_sql(
    "t", HIGH_ENTROPY_CANDIDATE, f"round({entropy_sql('h')}, 9) >= {HIGH_ENTROPY_BITS}", HIGH_ENTROPY_MARKER
)
_LOCAL, _DOMAIN = "string_split(h, '@')[1]", "string_split(h, '@')[-1]"
EMAIL = redact_where_sql(
    "t",
    P.EMAIL_CANDIDATE,
    f"strlen({_LOCAL}) <= {P.EMAIL_LOCAL_MAX} AND strlen({_DOMAIN}) <= {P.EMAIL_DOMAIN_MAX} "
    f"AND regexp_matches(h, {q(P.EMAIL_SHAPE)})",
    P.EMAIL_MARKER,
)
_DIGITS = "regexp_replace(h, '[ -]', '', 'g')"
CARD = redact_where_sql(
    "t", P.CARD_CANDIDATE, f"regexp_matches({_DIGITS}, {q(card_pattern())}) AND {luhn_sql(_DIGITS)}", P.CARD_MARKER
)
IBAN = redact_where_sql(
    "t", P.IBAN_CANDIDATE, f"regexp_matches(h, {q(iban_pattern())}) AND {mod97_sql('h')}", P.IBAN_MARKER
)
_NUMBER = "concat(CASE WHEN starts_with(h, '+') THEN '+' ELSE '' END, regexp_replace(h, '[^0-9]', '', 'g'))"
PHONE = redact_where_sql("t", P.PHONE_CANDIDATE, f"regexp_matches({_NUMBER}, {q(phone_pattern('FR'))})", P.PHONE_MARKER)
SSN = rule_sql("t", rule("ssn"))
# Most words need no table, and most others only that part of it that covers Latin-1.
_NEAR = [pair for pair in zip(*LOOKALIKES) if pair[0] <= "\xff"]
_FOLDED = (
    "CASE WHEN regexp_matches(h, '^[A-Za-z]*$') THEN lower(h) "
    rf"WHEN regexp_matches(h, '^[\x{{21}}-\x{{7E}}\x{{C0}}-\x{{FF}}]*$') "
    f"THEN translate(lower(h), {q(''.join(a for a, _ in _NEAR))}, {q(''.join(b for _, b in _NEAR))}) "
    f"ELSE translate(lower(h), {q(LOOKALIKES[0])}, {q(LOOKALIKES[1])}) END"
)
_STARRED = "concat(substr(h, 1, 1), repeat('*', length(h) - 1))"
PROFANE_WORDS = replace_where_sql(
    "t", WORD_PATTERN, f"CASE WHEN regexp_matches({_FOLDED}, {q(profane_pattern())}) THEN {_STARRED} ELSE h END"
)
PROFANE_RUNS = replace_where_sql(
    "t",
    SPACED_PATTERN,
    rf"CASE WHEN regexp_matches(lower(regexp_replace(h, '[ ._\-]', '', 'g')), {q(profane_stem())}) "
    "THEN concat(substr(h, 1, 1), regexp_replace(substr(h, 2), '[A-Za-z]', '*', 'g')) ELSE h END",
)
PROFANE_STEPS = (PROFANE_WORDS, PROFANE_RUNS)


def lexicon_sql(field: int, pattern=profane_pattern) -> str:
    """Category or severity of a folded word ``w``: that of the severest kind that fits."""
    kinds: dict = {}
    for stem, kind in PROFANE_LEXICON.items():
        kinds.setdefault(kind, []).append(stem)
    order = sorted(kinds, key=lambda kind: (-kind[1], [-ord(c) for c in kind[0]]))
    return "CASE " + " ".join(
        f"WHEN regexp_matches(w, {q(pattern(tuple(kinds[kind])))}) THEN {q(kind[0]) if field == 0 else kind[1]}"
        for kind in order
    ) + " END"


# Without its final newline a text splits into its lines; chr(13) only matters before a newline.
NORMAL = rf"regexp_replace(replace(t, concat(chr(13), {NL}), {NL}), '\n\z', '')"
FRAME = f"(regexp_matches(line, {q(FRAME_PATTERN)}) AND (" + " OR ".join(
    f"contains(line, {q(f)})" for f in INTERNAL_FRAGMENTS
) + "))"
TOKENS = f"CASE WHEN {blank_sql('{x}')} THEN 0 ELSE len(regexp_extract_all({{x}}, {q(TOKEN_PATTERN).replace('{', '{{').replace('}', '}}')})) END"
WORDS = rf"floor(len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) * {WORD_FACTOR}::DOUBLE)::BIGINT"


def tokens_sql(x: str) -> str:
    return TOKENS.format(x=x)


# ---- Pipelines as chains of common table expressions ----------------------------------------


def base_ctes() -> str:
    return f"logs AS ({LOGS_SQL}), corpus AS ({CORPUS_SQL}), s0 AS (SELECT *, text AS t FROM corpus)"


def mapped(*steps: str, name: str = "text", keys: str = K, base: str | None = None) -> str:
    """Apply expressions over ``t`` one after the other and select the result."""
    ctes, last = steps_ctes(steps, base)
    return f"WITH {ctes} SELECT {keys}, t AS {name} FROM {last}"


def steps_ctes(steps, base: str | None = None, prefix: str = "s") -> tuple[str, str]:
    parts, last = [base_ctes() if base is None else base], f"{prefix}0"
    for i, step in enumerate(steps, 1):
        parts.append(f"{prefix}{i} AS (SELECT * REPLACE ({step} AS t) FROM {last})")
        last = f"{prefix}{i}"
    return ", ".join(p for p in parts if p), last


def split_ctes(name: str, source: str, keys: str = K, column: str = "t") -> str:
    """Lines of each text as (keys, no, line); the empty text has none."""
    return (
        f"{name} AS (SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS no FROM "
        f"(SELECT {keys}, string_split({NORMAL.replace('(t,', f'({column},')}, {NL}) AS ls FROM {source} WHERE {column} <> ''))"
    )


def prune_ctes(out: str, lines: str, keys: str = K) -> str:
    return f"""
    {out}_f AS (SELECT *, {FRAME} AS frame FROM {lines}),
    {out}_g AS (SELECT *, CASE WHEN frame AND lag(frame) OVER w THEN 0 ELSE 1 END AS fresh FROM {out}_f
                WINDOW w AS (PARTITION BY {keys} ORDER BY no)),
    {out}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY no) AS island FROM {out}_g),
    {out} AS (SELECT {keys}, min(no) AS no, count(*) AS n,
                CASE WHEN any_value(frame) THEN concat({q(PRUNED_PREFIX)}, count(*), {q(PRUNED_SUFFIX)})
                     ELSE any_value(line) END AS line
              FROM {out}_i GROUP BY {keys}, island)"""


def collapse_ctes(out: str, lines: str, keys: str = K) -> str:
    return f"""
    {out}_g AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS fresh FROM {lines}
                WINDOW w AS (PARTITION BY {keys} ORDER BY no)),
    {out}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY no) AS island FROM {out}_g),
    {out} AS (SELECT {keys}, min(no) AS no, count(*) AS n,
                CASE WHEN count(*) > 1 THEN concat(any_value(line), ' (Repeated ', count(*), 'x)')
                     ELSE any_value(line) END AS line
              FROM {out}_i GROUP BY {keys}, island)"""


def join_ctes(out: str, source: str, lines: str, keys: str = K) -> str:
    """Put lines back together; texts without lines become empty."""
    on = " AND ".join(f"a.{k.strip()} = j.{k.strip()}" for k in keys.split(","))
    return f"""
    {out}_j AS (SELECT {keys}, string_agg(line, {NL} ORDER BY no) AS joined FROM {lines} GROUP BY {keys}),
    {out} AS (SELECT a.* REPLACE (coalesce(j.joined, '') AS t) FROM {source} a LEFT JOIN {out}_j j ON {on})"""


STAGE1_STEPS = (
    rules_sql("t", STAGE1_RULES),
    ENTROPY,
    rules_sql("t", NORMALIZE_RULES),
)
PII_STEPS = (SSN, EMAIL, CARD, IBAN, PHONE)


def clean_ctes(out: str, base: str | None = None, keys: str = K, p: str = "s") -> str:
    """Stage 1 from ``{p}0`` (which has a column t) to ``out``."""
    steps = (f"CASE WHEN {blank_sql('t')} THEN '' ELSE t END", *STAGE1_STEPS)
    ctes, last = steps_ctes(steps, base, p)
    return ", ".join(
        (
            ctes,
            split_ctes(f"{p}_lines", last, keys),
            prune_ctes(f"{p}_pruned", f"{p}_lines", keys),
            collapse_ctes(f"{p}_short", f"{p}_pruned", keys),
            join_ctes(out, last, f"{p}_short", keys),
        )
    )


def sanitized_ctes(base: str | None = None, keys: str = K, p: str = "s", out: str = "clean") -> str:
    """All stages to ``out``, which has t (clean text), censored before as flagged."""
    parts = [clean_ctes(f"{p}_c0", base, keys, p)]
    for i, step in enumerate(PII_STEPS):
        parts.append(f"{p}_c{i + 1} AS (SELECT * REPLACE ({step} AS t) FROM {p}_c{i})")
    n = len(PII_STEPS)
    parts.append(f"{p}_c{n + 1} AS (SELECT *, t AS before_censor FROM {p}_c{n})")
    parts.append(f"{p}_c{n + 2} AS (SELECT * REPLACE ({PROFANE_WORDS} AS t) FROM {p}_c{n + 1})")
    parts.append(f"{p}_c{n + 3} AS (SELECT * REPLACE ({PROFANE_RUNS} AS t) FROM {p}_c{n + 2})")
    parts.append(f"{out} AS (SELECT *, t <> before_censor AS flagged_profanity FROM {p}_c{n + 3})")
    return ", ".join(parts)




# ---- Places of findings: hits become stand-ins of their length, places are window sums over pieces -----------


def stand_in_sql(x: str, name: str) -> str:
    k = SPAN_RULES.index(name)
    return f"concat(chr({FIRST + k}), repeat(chr({FURTHER + k}), (length({x}) - 1)::BIGINT))"


def marked_rule_sql(r: Rule) -> str:
    pattern = ("(?i)" if r.ignore_case else "") + r.pattern
    front, back = KEPT.get(r.name, ("", ""))
    if not front:
        return replace_where_sql("t", pattern, stand_in_sql("h", r.name))
    kept = f"regexp_replace(h, {q(pattern)}, {q(front.replace('$', chr(92)))})"
    value = f"substr(h, length({kept}) + 1, length(h) - length({kept}) - {len(back)})"
    return replace_where_sql("t", pattern, f"concat({kept}, {stand_in_sql(value, r.name)}, {q(back)})")


def marked_ctes(out: str) -> str:
    def unmarked(step: str, marker: str, name: str) -> str:
        return step.replace(q(marker), stand_in_sql("h", name))

    steps = [
        rule_sql("t", STAGE1_RULES[0]),
        *(marked_rule_sql(r) for r in STAGE1_RULES[1:]),
        unmarked(ENTROPY, HIGH_ENTROPY_MARKER, "high_entropy"),
        *(marked_rule_sql(r) for r in (*NORMALIZE_RULES, rule("ssn"))),
        unmarked(EMAIL, P.EMAIL_MARKER, "email"),
        unmarked(CARD, P.CARD_MARKER, "card"),
        unmarked(IBAN, P.IBAN_MARKER, "iban"),
        unmarked(PHONE, P.PHONE_MARKER, "phone"),
    ]
    ctes, last = steps_ctes(steps)
    own, codes = rf"[\x{{{FIRST:X}}}-\x{{{FURTHER - 1:X}}}][\x{{{FURTHER:X}}}-\x{{{FURTHER + 127:X}}}]*", STAGE1_RULES[0].pattern

    def pieces(name: str, column: str, pattern: str, source: str) -> str:
        return f"""{name}_p AS (SELECT {K}, h, i, coalesce(length(g), 0) AS lead, coalesce(length(h), 0) AS len FROM
            (SELECT {K}, unnest(regexp_extract_all({column}, {q(pattern)})) AS h, unnest(string_split_regex({column}, {q(pattern)})) AS g,
                    generate_subscripts(string_split_regex({column}, {q(pattern)}), 1) AS i FROM {source} WHERE regexp_matches({column}, {q(pattern)})))"""

    rules = "[" + ", ".join(q(name) for name in SPAN_RULES) + "]"
    return f"""{ctes}, {pieces('hit', 't', own, last)}, {pieces('code', 'text', codes, 's0')},
      hits AS (SELECT * FROM (SELECT {K}, h, len, sum(lead) OVER w + sum(len) OVER w - len AS at FROM hit_p
               WINDOW w AS (PARTITION BY {K} ORDER BY i)) WHERE h IS NOT NULL),
      codes AS (SELECT * FROM (SELECT {K}, h, len, sum(lead) OVER w AS at FROM code_p
                WINDOW w AS (PARTITION BY {K} ORDER BY i)) WHERE h IS NOT NULL),
      {out} AS (SELECT {K}, {rules}[unicode(hits.h) - {FIRST} + 1] AS rule,
                (hits.at + coalesce(sum(codes.len) FILTER (codes.at <= hits.at), 0))::BIGINT AS span_start,
                (hits.at + hits.len + coalesce(sum(codes.len) FILTER (codes.at < hits.at + hits.len), 0))::BIGINT AS span_end
                FROM hits LEFT JOIN codes USING ({K}) GROUP BY {K}, hits.h, hits.at, hits.len)"""


DOCS0 = "s0 AS (SELECT *, text AS t FROM documents)"
REPLIES = f"replies AS (SELECT doc_id, {REPLY_SQL} AS reply FROM (SELECT *, {REPLY_BODY_SQL} AS body FROM documents))"


def _json_text(path: str) -> str:
    value = f"CASE WHEN json_valid(reply) AND json_type(reply, '{path}') = 'VARCHAR' THEN json_extract_string(reply, '{path}') END"
    return f"nullif({trim_sql(value)}, '')"


READ = f"read AS (SELECT doc_id, coalesce({_json_text('$.response')}, {_json_text('$.choices[0].message.content')}) AS t FROM replies)"
FENCES = f"""
  f1 AS (SELECT doc_id, {trim_sql('t')} AS t FROM read),
  f2 AS (SELECT doc_id, CASE WHEN NOT starts_with(t, '```') THEN t
                             WHEN contains(t, {NL}) THEN regexp_replace(substr(t, strpos(t, {NL}) + 1), '^\\s+', '')
                             ELSE ltrim(t, '`') END AS t FROM f1),
  f3 AS (SELECT doc_id, CASE WHEN ends_with(t, '```') THEN left(t, length(t) - 3) ELSE t END AS t FROM f2),
  fenced AS (SELECT doc_id, {trim_sql('t')} AS t FROM f3)"""
BYTES = f"strlen({trim_sql('{x}')})"


def eligible_sql(x: str) -> str:
    trimmed = trim_sql(x)
    return (
        f"(strlen({trimmed}) >= {RW.MIN_BYTES} AND "
        f"(contains({trimmed}, {NL}) OR strlen({trimmed}) >= {RW.MIN_SINGLE_LINE_BYTES}))"
    )


def accepted_sql(original: str, cleaned: str) -> str:
    least = f"floor(greatest(strlen({trim_sql(original)}) * {RW.RETAINED_SHARE}::DOUBLE, {RW.MIN_BYTES}))"
    return f"coalesce({cleaned} <> '' AND {cleaned} <> {original} AND strlen({cleaned}) >= {least}, false)"


def rewritten_ctes(base: str, keys: str, document: str) -> str:
    """Replies merged into the stage-1 texts; ``document`` is true where c and f are of one document."""
    return f"""{sanitized_ctes(base, keys)}, {REPLIES}, {READ}, {FENCES},
  merged AS (SELECT c.*, f.t AS rewrite, {eligible_sql('c.t')} AND {accepted_sql('c.t', 'f.t')} AS is_distilled
             FROM clean c LEFT JOIN fenced f ON {document}),
  r0 AS (SELECT {keys}, rewrite AS t FROM merged WHERE is_distilled)"""


def safe_ctes(base: str, keys: str, document: str) -> str:
    return f"""{rewritten_ctes(base, keys, document)}, {sanitized_ctes('', keys, 'r', 'again')},
  safe AS (SELECT {', '.join(f'm.{k.strip()}' for k in keys.split(','))}, m.text AS raw_text, m.t AS stage1_text,
                  m.is_distilled, m.flagged_profanity, CASE WHEN m.is_distilled THEN a.t ELSE m.t END AS sanitized_text
           FROM merged m LEFT JOIN again a USING ({keys}))"""


REWRITTEN = rewritten_ctes(DOCS0, "doc_id", "c.doc_id = f.doc_id")
SAFE = safe_ctes(DOCS0, "doc_id", "c.doc_id = f.doc_id")


def stats_select(source: str, raw: str, clean: str) -> str:
    return f"""(SELECT *, greatest(raw_tokens - sanitized_tokens, 0) AS saved_tokens,
        CASE WHEN raw_tokens > 0
             THEN round(greatest(raw_tokens - sanitized_tokens, 0) / raw_tokens * 100 * 10) / 10 ELSE 0.0 END AS reduction_percent
      FROM (SELECT *, ({tokens_sql(raw)})::BIGINT AS raw_tokens, ({tokens_sql(clean)})::BIGINT AS sanitized_tokens FROM {source}))"""


STATS = f"{sanitized_ctes()}, stats AS {stats_select('clean', 'text', 't')}"

_MARKER_RE = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in MARKERS)
_MARKER_MAP = "CASE m " + " ".join(f"WHEN {q(m)} THEN {q(n)}" for m, n in MARKERS.items()) + " END"


def found_ctes(source: str, keep: str) -> str:
    return f"""marks AS (SELECT {keep}, unnest(regexp_extract_all(t, {q(_MARKER_RE)})) AS m FROM {source}),
      found AS (SELECT {keep}, {_MARKER_MAP} AS rule, count(*) AS n FROM marks GROUP BY ALL)"""


# ---- Diff: occurrence join, with the display order as a sort key ------------------------------

DOCS_AS_CORPUS = "s0 AS (SELECT 'documents' AS corpus, doc_id AS id, 0::BIGINT AS part, text, text AS t FROM documents)"


def ends_ctes(name: str, source: str, keys: str = K, column: str = "t") -> str:
    """Lines with their newlines as (keys, no, line)."""
    return (
        f"{name} AS (SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS no FROM "
        rf"(SELECT {keys}, regexp_extract_all({column}, '[^\n]*\n|[^\n]+') AS ls FROM {source} WHERE {column} <> ''))"
    )


def diff_ctes(source: str = "clean", raw: str = "text", clean: str = "t", split=split_ctes) -> str:
    """The diff of two columns.

    Texts whose occurrence pairs cross get the table of longest common subsequences of all prefixes,
    row by row, and a walk back through it: up while the table does not change, else left while the
    row above is still shorter.
    """
    return f"""
  {split('old_lines', source, K, raw)}, {split('new_lines', source, K, clean)},
  o AS (SELECT *, row_number() OVER (PARTITION BY {K}, line ORDER BY no) AS occ FROM old_lines),
  w AS (SELECT *, row_number() OVER (PARTITION BY {K}, line ORDER BY no) AS occ FROM new_lines),
  occurs AS (SELECT {K}, coalesce(o.line, w.line) AS content, o.no AS old_no, w.no AS new_no
             FROM o FULL OUTER JOIN w USING ({K}, line, occ)),
  crossing AS (SELECT DISTINCT {K} FROM (
      SELECT {K}, new_no < lag(new_no) OVER (PARTITION BY {K} ORDER BY old_no) AS back
      FROM occurs WHERE old_no IS NOT NULL AND new_no IS NOT NULL) WHERE back),
  sides AS (SELECT * FROM (SELECT {K}, list(line ORDER BY no) AS olds FROM old_lines SEMI JOIN crossing USING ({K}) GROUP BY {K})
            JOIN (SELECT {K}, list(line ORDER BY no) AS news FROM new_lines SEMI JOIN crossing USING ({K}) GROUP BY {K}) USING ({K})),
  grown AS (SELECT {K}, 0 AS i, list_transform(range(0, len(news) + 1), lambda j: 0) AS lens FROM sides
            UNION ALL
            SELECT {K}, i + 1, list_transform(range(1, len(cell) + 1), lambda j: list_max(cell[1:j])) FROM (
              SELECT {K}, g.i, list_transform(range(1, len(s.news) + 2), lambda j: greatest(g.lens[j],
                       CASE WHEN j > 1 AND s.news[j - 1] = s.olds[g.i + 1] THEN g.lens[j - 1] + 1 ELSE 0 END)) AS cell
              FROM grown g JOIN sides s USING ({K}) WHERE g.i < len(s.olds))),
  walk AS (SELECT {K}, len(olds) AS i, len(news) AS j, false AS pair FROM sides
           UNION ALL
           SELECT {K}, CASE WHEN up OR NOT aside THEN i - 1 ELSE i END, CASE WHEN up THEN j ELSE j - 1 END, NOT up AND NOT aside
           FROM (SELECT {K}, k.i, k.j, a.lens[k.j + 1] = b.lens[k.j + 1] AS up, a.lens[k.j] > b.lens[k.j] AS aside
                 FROM walk k JOIN grown a USING ({K}, i) JOIN (SELECT {K}, i + 1 AS i, lens FROM grown) b USING ({K}, i)
                 WHERE k.i > 0 AND k.j > 0)),
  aligned AS (SELECT {K}, i + 1 AS old_no, j + 1 AS new_no FROM walk WHERE pair),
  pairs AS (SELECT * FROM occurs ANTI JOIN crossing USING ({K})
            UNION ALL BY NAME
            SELECT {K}, coalesce(x.line, y.line) AS content, x.no AS old_no, y.no AS new_no
            FROM (SELECT l.*, a.new_no AS other FROM old_lines l SEMI JOIN crossing USING ({K})
                  LEFT JOIN aligned a ON a.corpus = l.corpus AND a.id = l.id AND a.part = l.part AND a.old_no = l.no) x
            FULL OUTER JOIN (SELECT *, no AS other FROM new_lines SEMI JOIN crossing USING ({K})) y USING ({K}, other)),
  ranked AS (SELECT *,
      count(CASE WHEN old_no IS NOT NULL AND new_no IS NOT NULL THEN 1 END) OVER (PARTITION BY {K} ORDER BY old_no NULLS LAST) AS by_old,
      count(CASE WHEN old_no IS NOT NULL AND new_no IS NOT NULL THEN 1 END) OVER (PARTITION BY {K} ORDER BY new_no NULLS LAST) AS by_new
    FROM pairs),
  placed AS (SELECT *,
      CASE WHEN new_no IS NULL THEN 'delete' WHEN old_no IS NULL THEN 'add' ELSE 'equal' END AS change_type,
      CASE WHEN new_no IS NULL THEN by_old WHEN old_no IS NULL THEN by_new ELSE by_old - 1 END AS block,
      CASE WHEN new_no IS NULL THEN 1 WHEN old_no IS NULL THEN 2 ELSE 3 END AS kind
    FROM ranked),
  diff AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY block, kind, coalesce(old_no, new_no)) AS pos,
                  change_type, old_no::INT AS old_line_no, new_no::INT AS new_line_no, content FROM placed)"""


DIFF = f"{sanitized_ctes()}, {diff_ctes()}"
COUNTED = f"""SELECT {K}, count(*) AS n_lines, count(*) FILTER (change_type = 'add') AS n_add,
    count(*) FILTER (change_type = 'delete') AS n_delete, count(*) FILTER (change_type = 'equal') AS n_equal FROM diff GROUP BY {K}"""

RENDERED = (
    "concat(coalesce(old_line_no::VARCHAR, ''), chr(9), coalesce(new_line_no::VARCHAR, ''), chr(9), "
    "CASE change_type WHEN 'delete' THEN '-' WHEN 'add' THEN '+' ELSE ' ' END, ' ', content)"
)

_LINES = f"""{base_ctes()}, {split_ctes('all_lines', 's0')}, line_table AS (SELECT corpus AS source, id, part, no AS line_no, line,
    row_number() OVER (PARTITION BY corpus ORDER BY id, part, no) AS no FROM all_lines)"""
_LINE_ROWS = "SELECT p.source, l.id, l.part, l.line_no, p.n, p.line FROM p JOIN line_table l USING (source, no)"

LEXICON = f"""{base_ctes()},
        terms AS (SELECT DISTINCT {_FOLDED} AS w FROM (SELECT unnest(regexp_extract_all(text, {q(WORD_PATTERN)})) AS h FROM benchmark)),
        words AS (SELECT DISTINCT {K}, {_FOLDED} AS w FROM (SELECT {K}, unnest(regexp_extract_all(t, {q(WORD_PATTERN)})) AS h FROM s0)),
        hits AS (SELECT * FROM words SEMI JOIN terms USING (w))"""

LOG0 = f"logs AS ({LOGS_SQL}), s0 AS (SELECT *, text AS t FROM logs)"
LOGS_CLEAN = sanitized_ctes(LOG0, "event_id")

ORACLE: dict[str, str] = {
    "scan_documents": "SELECT doc_id AS id, text, lang, source FROM documents",
    "sanitize_pipeline": f"""WITH {SAFE}, stats AS {stats_select('safe', 'raw_text', 'sanitized_text')}
        SELECT doc_id, raw_text, stage1_text, sanitized_text, is_distilled, flagged_profanity,
               raw_tokens, sanitized_tokens, saved_tokens, reduction_percent FROM stats""",
    "sink_roundtrip": f"WITH {sanitized_ctes()} SELECT {K}, lang, t AS sanitized_text FROM clean",
    "stream_sanitize": f"WITH {LOGS_CLEAN} SELECT event_id, source, t AS sanitized_text, flagged_profanity FROM clean",
    "latest_per_source": f"""WITH {LOGS_CLEAN}
        SELECT source, event_id, t AS text FROM clean
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) = 1""",
    "result_json": f"""WITH RECURSIVE {sanitized_ctes(DOCS_AS_CORPUS)}, {diff_ctes()}, stats AS {stats_select('clean', 'text', 't')},
        counted AS (SELECT id, count(*) AS n, count(*) FILTER (change_type = 'delete') AS d FROM diff GROUP BY id)
        SELECT s.id AS doc_id, s.text AS raw_text, s.t AS sanitized_text, s.t AS stage1_text, false AS is_distilled,
               raw_tokens, sanitized_tokens, saved_tokens, reduction_percent,
               coalesce(n, 0) AS n_diff_lines, coalesce(d, 0) AS n_deleted
        FROM stats s LEFT JOIN counted USING (id)""",
    "prompt_rows": f"""WITH {sanitized_ctes(DOCS_AS_CORPUS)}
        SELECT id AS doc_id, concat({q(RW.INSTRUCTION)}, {NL}, {NL}, 'LOG:', {NL}, t) AS prompt,
        {RW.MAX_NEW_TOKENS}::BIGINT AS num_predict, {RW.TEMPERATURE}::DOUBLE AS temperature
        FROM clean WHERE {eligible_sql('t')}""",
    "chat_rows": f"""WITH {sanitized_ctes(DOCS0, 'doc_id')}
        SELECT doc_id, 'system' AS first_role, {q(RW.INSTRUCTION)} AS instruction, 'user' AS second_role, t AS text,
               {RW.MAX_NEW_TOKENS}::BIGINT AS max_tokens, {RW.TEMPERATURE}::DOUBLE AS temperature
        FROM clean WHERE {eligible_sql('t')}""",
    "nonblank_docs": f"WITH {base_ctes()} SELECT {K}, text FROM corpus WHERE NOT {blank_sql('text')}",
    "diff_search": f"WITH RECURSIVE {DIFF} SELECT * FROM diff WHERE contains(lower(content), 'redacted')",
    "distill_eligible": f"WITH {base_ctes()} SELECT {K}, {eligible_sql('text')} AS eligible FROM corpus",
    "distill_guard": f"""WITH {sanitized_ctes(DOCS0, 'doc_id')}, {REPLIES}, {READ}, {FENCES}
        SELECT doc_id, {accepted_sql('c.t', 'f.t')} AS accepted FROM clean c JOIN fenced f USING (doc_id)""",
    "record_full": f"""WITH RECURSIVE {safe_ctes(base_ctes(), K, "c.corpus = 'documents' AND c.id = f.doc_id")},
        {diff_ctes('safe', 'raw_text', 'sanitized_text')}, counted AS ({COUNTED}), stats AS {stats_select('safe', 'raw_text', 'sanitized_text')}
        SELECT {K}, raw_text, stage1_text, sanitized_text, is_distilled, flagged_profanity,
               raw_tokens, sanitized_tokens, saved_tokens, reduction_percent,
               coalesce(n_equal, 0) AS n_equal, coalesce(n_add, 0) AS n_add, coalesce(n_delete, 0) AS n_delete
        FROM stats LEFT JOIN counted USING ({K})""",
    **{f"rule_{r.name}": mapped(rule_sql("t", r)) for r in ALL_RULES},
    "high_entropy": mapped(ENTROPY),
    "email": mapped(EMAIL),
    "card": mapped(CARD),
    "iban": mapped(IBAN),
    "phone": mapped(PHONE),
    "entropy_scalar": mapped(f"round({entropy_sql('t')}, 6)", name="entropy"),
    "profanity_flag": f"WITH {steps_ctes(PROFANE_STEPS)[0]} SELECT {K}, t <> text AS flagged FROM s2",
    "profanity_censor": mapped(*PROFANE_STEPS),
    "profanity_hits": f"""WITH {base_ctes()},
        words AS (SELECT {K}, h AS word, {_FOLDED} AS w, no FROM (
            SELECT {K}, unnest(hs) AS h, generate_subscripts(hs, 1) AS no FROM (SELECT {K}, regexp_extract_all(t, {q(WORD_PATTERN)}) AS hs FROM s0))),
        runs AS (SELECT {K}, h AS word, lower(regexp_replace(h, '[ ._\\-]', '', 'g')) AS w, no FROM (
            SELECT {K}, unnest(hs) AS h, generate_subscripts(hs, 1) + 1000000000 AS no FROM (SELECT {K}, regexp_extract_all(t, {q(SPACED_PATTERN)}) AS hs FROM s0))),
        graded AS (SELECT {K}, no, word, {lexicon_sql(0)} AS category, {lexicon_sql(1)} AS severity FROM words UNION ALL
                   SELECT {K}, no, word, {lexicon_sql(0, profane_stem)}, {lexicon_sql(1, profane_stem)} FROM runs)
        SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY no) AS pos, word, category, severity FROM graded WHERE category IS NOT NULL""",
    "lexicon_flag": f"""WITH {LEXICON}
        SELECT {K}, n IS NOT NULL AS flagged FROM corpus LEFT JOIN (SELECT {K}, count(*) AS n FROM hits GROUP BY {K}) USING ({K})""",
    "lexicon_censor": f"""WITH {LEXICON}, held AS (SELECT {K}, list(w) AS ws FROM hits GROUP BY {K}),
        texts AS (SELECT s0.*, ws FROM s0 LEFT JOIN held USING ({K}))
        SELECT {K}, CASE WHEN ws IS NULL THEN t ELSE
          {replace_where_sql('t', WORD_PATTERN, f"CASE WHEN list_contains(ws, {_FOLDED}) THEN {_STARRED} ELSE h END")} END AS text FROM texts""",
    "lexicon_phrases": f"""WITH {base_ctes()},
        item_words AS (SELECT item_id, {_FOLDED} AS w, no FROM (SELECT item_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS no
            FROM (SELECT item_id, regexp_extract_all(text, {q(WORD_PATTERN)}) AS hs FROM benchmark))),
        pairs AS (SELECT item_id, concat(w, ' ', lead(w) OVER i) AS term, lead(w) OVER i AS more FROM item_words
            WINDOW i AS (PARTITION BY item_id ORDER BY no)),
        terms AS (SELECT term, count(DISTINCT item_id) AS n FROM pairs WHERE more IS NOT NULL GROUP BY term),
        words AS (SELECT {K}, {_FOLDED} AS w, no FROM (SELECT {K}, unnest(hs) AS h, generate_subscripts(hs, 1) AS no
            FROM (SELECT {K}, regexp_extract_all(t, {q(WORD_PATTERN)}) AS hs FROM s0))),
        found AS (SELECT {K}, no, concat(w, ' ', lead(w) OVER i) AS term, lead(w) OVER i AS more FROM words
            WINDOW i AS (PARTITION BY {K} ORDER BY no))
        SELECT {K}, no::BIGINT AS pos, 2 AS n_words, term, CASE WHEN n > 1 THEN 'shared' ELSE 'single' END AS category,
               least(n, 3)::INT AS severity FROM found JOIN terms USING (term) WHERE more IS NOT NULL""",
    "split_lines": f"WITH {base_ctes()}, {split_ctes('l', 's0')} SELECT {K}, no AS line_no, line FROM l",
    "prune_frames": f"WITH {base_ctes()}, {split_ctes('l', 's0')}, {prune_ctes('p', 'l')}, {join_ctes('j', 's0', 'p')} SELECT {K}, t AS text FROM j",
    "collapse_duplicates": f"WITH {base_ctes()}, {split_ctes('l', 's0')}, {collapse_ctes('p', 'l')}, {join_ctes('j', 's0', 'p')} SELECT {K}, t AS text FROM j",
    "prune_rows": f"WITH {_LINES}, {prune_ctes('p', 'line_table', 'source')} {_LINE_ROWS}",
    "collapse_rows": f"WITH {_LINES}, {collapse_ctes('p', 'line_table', 'source')} {_LINE_ROWS}",
    "token_estimate": mapped(f"({tokens_sql('t')})::BIGINT", name="tokens"),
    "token_words": mapped(WORDS, name="tokens"),
    "token_stats": f"WITH {STATS} SELECT {K}, raw_tokens, sanitized_tokens, saved_tokens, reduction_percent FROM stats",
    "stats_label": f"""WITH {STATS} SELECT {K}, concat('Stage 1 Rule | ', raw_tokens, ' → ', sanitized_tokens, ' tokens | -',
        CASE WHEN reduction_percent = floor(reduction_percent) THEN reduction_percent::BIGINT::VARCHAR
             ELSE reduction_percent::VARCHAR END, '%') AS label FROM stats""",
    "diff_lines": f"WITH RECURSIVE {DIFF} SELECT * FROM diff",
    "diff_rows": f"""WITH RECURSIVE {DIFF} SELECT {K}, old_line_no, new_line_no, change_type, content FROM diff""",
    "diff_terminated": f"""WITH RECURSIVE {sanitized_ctes()}, {diff_ctes(split=ends_ctes)}
        SELECT * REPLACE (replace(content, {NL}, '') AS content) FROM diff""",
    "diff_summary": f"""WITH RECURSIVE {DIFF}, counted AS ({COUNTED})
        SELECT {K}, coalesce(n_lines, 0) AS n_lines, coalesce(n_add, 0) AS n_add,
               coalesce(n_delete, 0) AS n_delete, coalesce(n_equal, 0) AS n_equal
        FROM clean c LEFT JOIN counted USING ({K})""",
    "diff_render": f"""WITH RECURSIVE {DIFF}, joined AS (SELECT {K}, string_agg({RENDERED}, {NL} ORDER BY pos) AS unified FROM diff GROUP BY {K})
        SELECT {K}, coalesce(unified, '') AS unified FROM clean c LEFT JOIN joined USING ({K})""",
    "apply_rewrites": f"WITH {REWRITTEN} SELECT doc_id, CASE WHEN is_distilled THEN rewrite WHEN {blank_sql('t')} THEN '' ELSE t END AS text, is_distilled FROM merged",
    "strip_fences": f"WITH {REPLIES}, {READ}, {FENCES} SELECT doc_id, t AS text FROM fenced",
    "reply_text": f"WITH {REPLIES}, {READ} SELECT doc_id, t AS text FROM read",
    "safety_pass": f"WITH {SAFE} SELECT doc_id, sanitized_text AS text, is_distilled FROM safe",
    "clean_stage1": f"WITH {clean_ctes('c')} SELECT {K}, t AS text FROM c",
    "redact_pii": mapped(*PII_STEPS),
    "sanitize_full": f"WITH {sanitized_ctes()} SELECT {K}, t AS text, flagged_profanity FROM clean",
    "finding_spans": f"WITH {marked_ctes('spans')} SELECT * FROM spans",
    "findings": f"WITH {sanitized_ctes()}, {found_ctes('clean', K)} SELECT {K}, rule, n FROM found",
    "redaction_report": f"""WITH {sanitized_ctes()}, {found_ctes('clean', K + ', source, lang')},
        total AS (SELECT {K}, source, lang, 'ALL' AS rule, sum(n) AS n FROM found GROUP BY {K}, source, lang)
        SELECT source, lang, rule, grouping(source) = 1 AS source_total, grouping(lang) = 1 AS lang_total,
               count(*) AS n_docs, sum(n)::BIGINT AS n_findings
        FROM (SELECT * FROM found UNION ALL BY NAME SELECT * FROM total) GROUP BY CUBE (source, lang), rule""",
    "token_report": f"""WITH {STATS} SELECT source, grouping(source) = 1 AS source_total, count(*) AS n_docs, sum(raw_tokens)::BIGINT AS raw_tokens,
          sum(saved_tokens)::BIGINT AS saved_tokens,
          CASE WHEN sum(raw_tokens) > 0 THEN round(sum(saved_tokens)::DOUBLE / sum(raw_tokens)::DOUBLE * 100 * 10) / 10 ELSE 0.0 END AS reduction_percent,
          round(quantile_cont(reduction_percent, 0.5), 4) AS median_percent, round(quantile_cont(reduction_percent, 0.9), 4) AS p90_percent
        FROM stats GROUP BY ROLLUP (source)""",
    "publishable": f"""WITH {sanitized_ctes()}, g0 AS (SELECT {K}, t AS kept, t FROM clean),
        {steps_ctes((rules_sql('t', STAGE1_RULES), ENTROPY, *PII_STEPS), '', 'g')[0]}
        SELECT {K}, kept AS text FROM g{2 + len(PII_STEPS)} WHERE t = kept""",
    "leak_gate": f"""WITH {base_ctes()}, g0 AS (SELECT {K}, text, t FROM s0),
        {steps_ctes((rules_sql('t', STAGE1_RULES), ENTROPY, *PII_STEPS), '', 'g')[0]}
        SELECT {K}, text FROM g{2 + len(PII_STEPS)} WHERE t = text""",
    "noisiest_docs": f"""WITH {steps_ctes(STAGE1_STEPS)[0]}, {split_ctes('l', 's3')}, {prune_ctes('p', 'l')}, {collapse_ctes('c', 'p')},
        before_n AS (SELECT {K}, count(*) AS b FROM l GROUP BY {K}), after_n AS (SELECT {K}, count(*) AS a FROM c GROUP BY {K}),
        shares AS (SELECT {K}, coalesce(b, 0)::BIGINT AS lines_before, coalesce(a, 0)::BIGINT AS lines_after,
                          CASE WHEN coalesce(b, 0) > 0 THEN round((b - a) / b, 6) ELSE 0.0 END AS noise_share
                   FROM s3 s LEFT JOIN before_n USING ({K}) LEFT JOIN after_n USING ({K}))
        SELECT * FROM shares ORDER BY noise_share DESC, {K} LIMIT 50""",
    "sanitize_conversations": f"""WITH {sanitized_ctes('s0 AS (SELECT *, text AS t FROM conversations)', 'conv_id, turn')}
        SELECT conv_id, floor(turn / 256)::BIGINT AS segment, count(*) AS n_turns,
               string_agg(concat(role, ': ', t), {NL} ORDER BY turn, concat(role, ': ', t)) AS transcript
        FROM clean GROUP BY 1, 2""",
    "conversation_turns": f"""WITH {sanitized_ctes('s0 AS (SELECT *, text AS t FROM conversations)', 'conv_id, turn')}
        SELECT conv_id, turn, role, t AS text FROM clean""",
    "stream_collapse": """WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events
             WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
        SELECT user_id AS source, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event,
               any_value(event_type) AS line, count(*) AS n FROM i GROUP BY user_id, island""",
    "stream_event_runs": """WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w
                  AND ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events
             WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
        SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id,
               any_value(event_type) AS line, count(*) AS n FROM i GROUP BY user_id, island""",
    "stream_marker_counts": f"""WITH {LOGS_CLEAN}, {found_ctes('clean', 'event_id, ts, source')}
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, source, rule, sum(n)::BIGINT AS n
        FROM found GROUP BY 1, 2, 3""",
    "stream_latest": f"""WITH {LOGS_CLEAN}
        SELECT source, event_id, t AS text FROM clean
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) = 1""",
}
# Reports kept by batches equal those of the whole table; every text is a document of its own.
ORACLE["kept_redactions"] = f"SELECT *, true AS distinct_near FROM ({ORACLE['redaction_report']})"
ORACLE["kept_tokens"] = ORACLE["token_report"]
ORACLE["sink_batches"] = ORACLE["sink_roundtrip"]
ORACLE["stream_sessions"] = f"""WITH {LOGS_CLEAN}, {found_ctes('clean', 'event_id')},
    e AS (SELECT source, c.event_id, c.ts::TIMESTAMP AS ts, coalesce(f.n, 0) AS n FROM clean c
          LEFT JOIN (SELECT event_id, sum(n) AS n FROM found GROUP BY event_id) f ON f.event_id = c.event_id),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 MINUTE THEN 0 ELSE 1 END AS fresh FROM e
          WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, source, count(*) AS n_texts, sum(n)::BIGINT AS n_findings
    FROM i GROUP BY source, island
    HAVING max(ts) + INTERVAL 6 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR"""
