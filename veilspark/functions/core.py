"""Native building blocks shared by every text operator.

Everything here returns a ``Column``; nothing needs a UDF or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]


def char_class(ascii: str, beyond: str) -> str:
    """A Java character class: the ASCII characters listed, and what the class body ``beyond`` has outside ASCII.

    Java looks a listed character up in one table, but asks the parts of a class like ``[\\p{L}\\p{N}@]`` in turn.
    """
    return "[[" + "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in ascii) + r"][\x{80}-\x{10FFFF}&&[" + beyond + "]]]"


def let(value: Column, body: ColumnFn) -> Column:
    """Evaluate ``value`` once and let ``body`` refer to it as often as it likes.

    A guarded rewrite mentions its input three times.  Chaining such rewrites as plain
    expressions would grow the tree exponentially; a lambda variable keeps it linear and
    does not depend on which projections Catalyst decides to collapse.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column that later filters cannot duplicate.

    Catalyst pushes a filter on a projected column below the projection, where the column is
    computed a second time.  It cannot do so below a generator, and it still pushes filters on
    all other columns down to the scan.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def when_guarded(value: Column, guard: ColumnFn, rewrite: ColumnFn) -> Column:
    """Apply ``rewrite`` only where the cheap ``guard`` says that it could change the text."""
    return let(value, lambda v: F.when(guard(v), rewrite(v)).otherwise(v))


def in_turn(value: Column, steps: list[ColumnFn]) -> Column:
    """Apply ``steps`` one after another, each to what the one before it left.

    The analyzer binds one link of a chain of ``let`` a round and gives up after 100 rounds; this takes the same few
    rounds for any number of steps.
    """
    if len(steps) == 1:
        return let(value, lambda v: steps[0](v))

    def step(left: Column, i: Column) -> Column:
        chosen = F.when(i == 0, steps[0](left))
        for k, each in enumerate(steps[1:-1], 1):
            chosen = chosen.when(i == k, each(left))
        return chosen.otherwise(steps[-1](left))

    return F.aggregate(F.lit(list(range(len(steps)))), value, step)


def contains_any(value: Column, literals: tuple[str, ...] | list[str]) -> Column:
    """Byte-level substring tests; on prose about 10x cheaper than one regex alternation."""
    if len(literals) == 1:
        return value.contains(literals[0])
    return F.exists(F.lit(list(literals)), lambda literal: value.contains(literal))


def replace_where(value: Column, pattern: str, fn: ColumnFn) -> Column:
    """Replace each match of ``pattern`` by ``fn(match)``; ``fn`` must not return null.

    ``pattern`` is a Java regex that never matches the empty string.
    """

    def body(v: Column) -> Column:
        gaps = F.split(v, pattern, -1)
        hits = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), fn)
        # There is one gap more than there are hits; array_join drops the null it pairs with.
        return F.array_join(F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, h))), "")

    return let(value, body)


def redact_where(value: Column, pattern: str, test: ColumnFn, marker: str) -> Column:
    """Find candidates, test each, and put ``marker`` in place of those that pass."""
    return replace_where(value, pattern, lambda hit: F.when(test(hit), F.lit(marker)).otherwise(hit))


def is_ascii(value: Column) -> Column:
    """True if the text is plain ASCII; counts bytes, which no search does as fast."""
    return F.octet_length(value) == F.char_length(value)


def rlike_unicode(value: Column, pattern: str) -> Column:
    """``value.rlike("(?U)" + pattern)``; in plain ASCII the classes have their plain, much faster meaning."""
    return F.when(is_ascii(value), value.rlike(pattern)).otherwise(value.rlike("(?U)" + pattern))


def is_nonblank(value: Column) -> Column:
    """True if the text has a character that is not Unicode white space."""
    return value.rlike(r"(?U)\S")


def _is_space(char: Column) -> Column:
    return char.rlike(r"(?U)\s")


def utrim(value: Column) -> Column:
    """Trim Unicode white space (Spark's own ``trim`` only strips the ASCII space).

    A look at the first and the last character spares most texts the search.
    """
    return when_guarded(
        value,
        lambda v: _is_space(F.left(v, F.lit(1))) | _is_space(F.right(v, F.lit(1))),
        lambda v: F.regexp_replace(v, r"(?U)\A\s++|(?<!\s)\s++\z", ""),
    )


def utrim_start(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\A\s++", "")


def utrim_end(value: Column) -> Column:
    return when_guarded(
        value, lambda v: _is_space(F.right(v, F.lit(1))), lambda v: F.regexp_replace(v, r"(?U)(?<!\s)\s++\z", "")
    )


def has_piece(value: Column, width: int) -> Column:
    """True if some piece without a blank or newline has at least ``width`` characters.

    Possessive loops make this a single pass: every shorter piece is stepped over once.
    """
    return value.rlike(rf"\A(?:[^ \n]{{0,{width - 1}}}+[ \n])*+[^ \n]{{{width}}}")


#: Texts of at least this many characters, of at most so many different ones, are measured without sorting.
_LONG, _FEW = 256, 128


def shannon_entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits per character; 0 for the empty text.

    The characters are sorted and cut into runs, so the cost does not grow with the alphabet. From a long text of
    few different characters each is taken out in turn and counted by what is left: common ones come early, so
    little is left soon.
    """

    def bits(count: Column, size: Column) -> Column:
        share = count / size
        return -share * F.log2(share)

    def over(chars: Column) -> Column:
        size = F.size(chars)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1)))

        def total(cut: Column) -> Column:
            counts = F.transform(cut, lambda start, k: F.coalesce(F.get(cut, k + 1), size) - start)
            return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + bits(n, size))

        return let(starts, total)

    def peeled(text: Column, kinds: Column, size: Column) -> Column:
        def take(acc: Column, char: Column) -> Column:
            def taken(left: Column) -> Column:
                n = (F.octet_length(acc["left"]) - F.octet_length(left)) / F.octet_length(char)
                return F.struct(left.alias("left"), (acc["bits"] + bits(n, size)).alias("bits"))

            return let(F.replace(acc["left"], char, F.lit("")), taken)

        start = F.struct(text.alias("left"), F.lit(0.0).alias("bits"))
        return F.aggregate(kinds, start, take, lambda acc: acc["bits"])

    def of_chars(text: Column, chars: Column) -> Column:
        kinds = F.when(F.size(chars) >= _LONG, F.array_distinct(chars))
        return let(
            kinds,
            lambda k: F.when(F.size(k) <= _FEW, let(F.size(chars), lambda size: peeled(text, k, size))).otherwise(
                let(F.sort_array(chars), over)
            ),
        )

    def body(v: Column) -> Column:
        return F.when(v == "", F.lit(0.0)).when(v.isNotNull(), let(F.split(v, ""), lambda chars: of_chars(v, chars)))

    return let(value, body)


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a string that holds only ASCII digits."""

    def body(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(d, -i, F.lit(1))) - 48
            doubled = digit * 2
            folded = F.when(doubled > 9, doubled - 9).otherwise(doubled)
            return acc + F.when(i % 2 == 0, folded).otherwise(digit)

        positions = F.sequence(F.lit(1), F.char_length(d))
        return F.aggregate(positions, F.lit(0), add) % 10 == 0

    return let(digits, body)


def mod97(account: Column) -> Column:
    """ISO 7064 remainder of an IBAN made of ASCII capitals and digits; 1 for a valid one."""

    def body(a: Column) -> Column:
        rotated = F.concat(F.substr(a, F.lit(5)), F.left(a, F.lit(4)))

        def add(acc: Column, char: Column) -> Column:
            code = F.ascii(char)
            return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.split(rotated, ""), F.lit(0), add)

    return let(account, body)
