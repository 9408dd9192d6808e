"""The skeleton of a word: lower case, marks stripped, look-alikes turned into the letters they imitate."""

from __future__ import annotations

import unicodedata
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import char_class

# ---- Fixed values: digits and signs, Cyrillic and Greek letters that look like Latin ones, and
# ---- characters that do not show.
SIGNS = "0o 1i 3e 4a 5s 7t @a $s"
CYRILLIC = "аa вb еe ёe кk мm нh оo рp сc тt уy хx іi їi јj ѕs ԁd ԛq ԝw һh"
GREEK = "αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ϲc"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Blocks whose characters stand for a Latin letter where their compatibility form is one: Latin with
#: accents, ligatures and letter-like signs, circled, full-width and mathematical letters.
BLOCKS = ((0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2100, 0x214F), (0x24B6, 0x24E9), (0xFF21, 0xFF5A), (0x1D400, 0x1D6A3))
#: Combining marks.
MARKS = (0x300, 0x36F)
# ---- End of fixed values.


def _plain(char: str) -> str | None:
    """The Latin letter that a character is a form of."""
    letters = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
    return letters if len(letters) == 1 and "a" <= letters <= "z" else None


def _table() -> tuple[str, str]:
    found = {chr(c): letter for a, b in BLOCKS for c in range(a, b + 1) if (letter := _plain(chr(c)))}
    for char, letter in f"{SIGNS} {CYRILLIC} {GREEK}".split():
        found[char] = found[char.upper()] = letter
    gone = INVISIBLE + "".join(map(chr, range(MARKS[0], MARKS[1] + 1)))
    return "".join(found) + gone, "".join(found.values())


#: Characters, and what takes their place; those without a counterpart go.
LOOKALIKES = _table()

_HIDDEN = r"\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
#: A word, with marks and characters that do not show inside it.
WORD_PATTERN = rf"[\p{{L}}\p{{N}}\p{{M}}@$\x{{24B6}}-\x{{24E9}}{_HIDDEN}]+"
#: The same matches, found faster by Java; the SQL has the plain form.
WORD_SEARCH = char_class(f"{ascii_letters}{digits}@$", rf"\p{{L}}\p{{N}}\p{{M}}\x{{24B6}}-\x{{24E9}}{_HIDDEN}") + "+"


def skeleton(text: Column) -> Column:
    """Lower case without marks and disguise; two texts that look alike have one skeleton."""
    return F.translate(F.lower(text), *LOOKALIKES)
