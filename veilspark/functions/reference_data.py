"""Lookup tables for the validated detectors: issuers, IBAN structures, numbering plans, lexicon.

All of it is fixed, public data stated as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# ---- Fixed values: payment card issuers, as (leading digits, allowed lengths).
CARD_ISSUERS: dict[str, tuple[str, str]] = {
    "visa": ("4", "13-19"),
    "mastercard": ("5[1-5]|2[2-7]", "16"),
    "amex": ("3[47]", "15"),
    "diners": ("3[0689]", "14"),
    "discover": ("6[045]|622", "16"),
    "unionpay": ("62|88", "16-19"),
    "jcb": ("35", "16"),
    "maestro": ("50[1-3]8|502|503|56|58|639|67", "13-19"),
    "forbrugsforeningen": ("600", "16"),
    "dankort": ("5019", "16"),
    "mir": ("220[0-4]", "16"),
}

# ---- Fixed values: IBAN account part per country in SWIFT notation (n digits, a capitals,
# ---- c capitals or digits), after the two-letter country code and two check digits.
IBAN_STRUCTURES: dict[str, str] = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n", "BE": "12n",
    "BG": "4a6n8c", "BH": "4a14c", "BR": "23n1a1c", "BY": "4c4n16c", "CH": "5n12c", "CR": "18n",
    "CY": "8n16c", "CZ": "20n", "DE": "18n", "DJ": "23n", "DK": "14n", "DO": "4c20n", "EE": "16n",
    "EG": "25n", "ES": "20n", "FI": "14n", "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n",
    "GE": "2a16n", "GI": "4a15c", "GL": "14n", "GR": "7n16c", "GT": "4c20c", "HR": "17n", "HU": "24n",
    "IE": "4a14n", "IL": "19n", "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c", "JO": "4a4n18c",
    "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c", "LC": "4a24c", "LI": "5n12c", "LT": "16n", "LU": "3n13c",
    "LV": "4a13c", "LY": "21n", "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MN": "16n",
    "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a", "NI": "4a20n", "NL": "4a10n", "NO": "11n", "PK": "4a16c",
    "PL": "24n", "PS": "4a21c", "PT": "21n", "QA": "4a21c", "RO": "4a16c", "RS": "18n", "RU": "14n15c",
    "SA": "2n18c", "SC": "4a20n3a", "SD": "14n", "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c",
    "ST": "21n", "SV": "4a20n", "TL": "19n", "TN": "20n", "TR": "6n16c", "UA": "6n19c", "VA": "18n",
    "VG": "4a16n", "XK": "16n",
}


# ---- Fixed values: numbering plans, as region, calling code, trunk prefix and international prefix (- for
# ---- none) and national numbers.
NUMBERING = r"""
AE 971 0 00 5[024-68][0-9]{7}|[2-4679][0-9]{7}
AR 54 0 00 11[0-9]{8}|[23][0-9]{9}|9(?:11|[23][0-9])[0-9]{8}
AT 43 0 00 1[0-9]{6,12}|[2-57][0-9]{7,11}|6[4-9][0-9]{8,10}|8[0-9]{8,9}|9[0-9]{8,9}
AU 61 0 0011 [23478][0-9]{8}
BD 880 0 00 1[3-9][0-9]{8}|[2-9][0-9]{6,9}
BE 32 0 00 4[5-9][0-9]{7}|[1-9][0-9]{7}
BG 359 0 00 2[0-9]{6,7}|[3-79][0-9]{6,8}|8[7-9][0-9]{7}
BH 973 - 00 [1367][0-9]{7}
BR 55 0 00 [1-9][1-9]9[0-9]{8}|[1-9][1-9][2-5][0-9]{7}
BY 375 8 810 (?:25|29|33|44)[0-9]{7}|1[5-7][0-9]{7}|2[1-4][0-9]{7}
CA 1 1 011 [2-9][0-9]{2}[2-9][0-9]{6}
CH 41 0 00 [2-9][0-9]{8}
CL 56 - 00 [2-9][0-9]{8}
CN 86 0 00 1[3-9][0-9]{9}|10[0-9]{8}|2[0-9]{9}|[3-9][0-9]{9,10}
CO 57 - 00 3[0-9]{9}|60[1-8][0-9]{7}
CZ 420 - 00 [2-9][0-9]{8}
DE 49 0 00 1(?:5[0-9]|6[023]|7[0-9])[0-9]{7,8}|[2-9][0-9]{6,10}
DK 45 - 00 [2-9][0-9]{7}
DZ 213 0 00 [5-7][0-9]{8}|[1-4][0-9]{7}
EC 593 0 00 9[0-9]{8}|[2-7][0-9]{7}
EE 372 - 00 5[0-9]{6,7}|[3467][0-9]{6}|8[0-9]{7}
EG 20 0 00 1[0125][0-9]{8}|2[0-9]{8}|3[0-9]{7}|[4-9][0-9]{7,8}
ES 34 - 00 [5-9][0-9]{8}
FI 358 0 00 4[0-9]{5,10}|50[0-9]{4,8}|[1-35689][0-9]{5,9}
FR 33 0 00 [1-7][0-9]{8}|8[0-2689][0-9]{7}|9[0-9]{8}
GB 44 0 00 1[0-9]{8,9}|2[0-9]{9}|3[0-9]{9}|7[1-57-9][0-9]{8}|8[047][0-9]{8}|9[0-9]{9}
GH 233 0 00 [235][0-9]{8}
GR 30 - 00 2[0-9]{9}|69[0-9]{8}
HK 852 - 001 [235-9][0-9]{7}
HR 385 0 00 1[0-9]{7}|[2-5][0-9]{7}|9[0-9]{7,8}
HU 36 06 00 1[0-9]{7}|(?:20|30|31|50|70)[0-9]{7}|[2-9][0-9]{7}
ID 62 0 00 8[1-9][0-9]{7,10}|[2-79][0-9]{7,9}
IE 353 0 00 1[0-9]{7}|2[1-9][0-9]{5,7}|[4-7][0-9]{6,8}|8[3-9][0-9]{7}|9[0-9]{6,8}
IL 972 0 00 5[0-9]{8}|7[2-9][0-9]{7}|[2-489][0-9]{7}
IN 91 0 00 [1-9][0-9]{9}
IS 354 - 00 [4-9][0-9]{6}|3[0-9]{8}
IT 39 - 00 0[0-9]{7,10}|3[0-9]{8,9}
JO 962 0 00 7[7-9][0-9]{7}|[2356][0-9]{7}
JP 81 0 010 [5789]0[0-9]{8}|[1-9][0-9]{8}
KE 254 0 000 [17][0-9]{8}|[2-6][0-9]{6,8}
KR 82 0 00 1[0-9]{8,9}|2[0-9]{7,8}|[3-6][1-5][0-9]{7,8}|70[0-9]{8}
KW 965 - 00 [2569][0-9]{7}
KZ 7 8 810 7[0-9]{9}
LB 961 0 00 [13-9][0-9]{6}|7[0-9]{7}|81[0-9]{6}
LK 94 0 00 [1-9][0-9]{8}
LT 370 0 00 [3-9][0-9]{7}
LU 352 - 00 6[2679][18][0-9]{6}|[2-57-9][0-9]{5,7}
LV 371 - 00 [269][0-9]{7}|8[01][0-9]{6}
MA 212 0 00 [5-8][0-9]{8}
MX 52 - 00 [2-9][0-9]{9}
MY 60 0 00 1[0-9]{8,9}|[3-9][0-9]{7,8}
NG 234 0 009 (?:70|80|81|90|91)[0-9]{8}|[1-9][0-9]{6,7}
NL 31 0 00 [1-7][0-9]{8}|8[58][0-9]{7}
NO 47 - 00 [2-9][0-9]{7}
NZ 64 0 00 2[0-9]{7,9}|[34679][0-9]{7}
OM 968 - 00 [279][0-9]{7}
PE 51 0 00 9[0-9]{8}|[14-8][0-9]{7}
PH 63 0 00 9[0-9]{9}|[2-8][0-9]{8}
PK 92 0 00 3[0-9]{9}|[24-9][0-9]{8,9}
PL 48 - 00 (?:1[2-8]|2[2-69]|3[2-4]|4[1-468]|5[0-9]|6[0-35-9]|7[1-9]|8[1-9]|9[145])[0-9]{7}
PT 351 - 00 [29][0-9]{8}
QA 974 - 00 [3-7][0-9]{7}
RO 40 0 00 [237][0-9]{8}|8[0-9]{8}|9[0-9]{8}
RS 381 0 00 6[0-9]{7,9}|[1-3][0-9]{6,9}
RU 7 8 810 [3489][0-9]{9}
SA 966 0 00 5[0-9]{8}|1[1-467][0-9]{7}
SE 46 0 00 7[02369][0-9]{7}|8[0-9]{6,8}|[1-69][0-9]{7,8}
SG 65 - 000 [3689][0-9]{7}
SI 386 0 00 [1-7][0-9]{7}
SK 421 0 00 [2-59][0-9]{8}
TH 66 0 001 [689][0-9]{8}|[2-7][0-9]{7}
TN 216 - 00 [2-57-9][0-9]{7}
TR 90 0 00 (?:2[1-9]|3[1-9]|4[1-9]|5[0-9]|8[058])[0-9]{8}
TW 886 0 002 9[0-9]{8}|[2-8][0-9]{7,8}
UA 380 0 00 [3-79][0-9]{8}
US 1 1 011 [2-9][0-9]{2}[2-9][0-9]{6}
UY 598 0 00 9[0-9]{7}|[24][0-9]{7}
VE 58 0 00 [24][0-9]{9}
VN 84 0 00 [35789][0-9]{8}|2[0-9]{9}
ZA 27 0 00 [1-8][0-9]{8}
"""
# ---- End of fixed values.


@dataclass(frozen=True)
class PhonePlan:
    calling_code: str
    trunk: str
    dial_out: str
    national: str


PHONE_PLANS: dict[str, PhonePlan] = {
    region: PhonePlan(code, trunk.strip("-"), dial_out, national)
    for region, code, trunk, dial_out, national in (row.split(" ") for row in NUMBERING.split("\n") if row)
}

# ---- Fixed values: national numbers of the other calling codes, by code or group of codes; codes with a plan of
# ---- their own above do not count here.
PHONE_ABROAD: tuple[tuple[str, str], ...] = (
    ("7", "[3-9][0-9]{9}"),
    ("20", "1[0-25][0-9]{8}|[2-9][0-9]{7,8}"),
    ("21[1368]", "[1-9][0-9]{7,8}"),
    ("22[0-9]", "[0-9]{7,10}"),
    ("23[0-9]", "[1-9][0-9]{6,9}"),
    ("24[0-9]", "[0-9]{7,9}"),
    ("25[0-8]", "[1-9][0-9]{6,8}"),
    ("26[0-9]", "[1-9][0-9]{6,8}"),
    ("27", "[1-8][0-9]{8}"),
    ("29[01789]", "[1-9][0-9]{5,6}"),
    ("30", "[26][0-9]{9}"),
    ("35[02-9]", "[1-9][0-9]{6,9}"),
    ("36", "[1-9][0-9]{7,8}"),
    ("37[0-8]", "[1-9][0-9]{6,8}"),
    ("38[0-35-79]", "[1-9][0-9]{7,8}"),
    ("40", "[2378][0-9]{8}"),
    ("42[013]", "[1-9][0-9]{6,8}"),
    ("43", "[1-9][0-9]{6,12}"),
    ("45", "[2-9][0-9]{7}"),
    ("46", "[1-9][0-9]{6,9}"),
    ("47", "[2-9][0-9]{7}"),
    ("48", "[1-9][0-9]{8}"),
    ("50[1-9]", "[2-9][0-9]{6,7}"),
    ("51", "[1-9][0-9]{7,8}"),
    ("52", "[1-9][0-9]{9,10}"),
    ("53", "[2-8][0-9]{7}"),
    ("54", "[1-9][0-9]{9,10}"),
    ("55", "[1-9]{2}[2-9][0-9]{7,8}"),
    ("56", "[2-9][0-9]{8}"),
    ("57", "[36][0-9]{9}"),
    ("58", "[24][0-9]{9}"),
    ("59[0-9]", "[1-9][0-9]{6,8}"),
    ("60", "[1-9][0-9]{7,9}"),
    ("61", "[2-478][0-9]{8}"),
    ("62", "[1-9][0-9]{7,11}"),
    ("63", "[2-9][0-9]{7,9}"),
    ("64", "[2-9][0-9]{7,9}"),
    ("65", "[3689][0-9]{7}"),
    ("66", "[2-9][0-9]{7,8}"),
    ("67[02-9]|68[0-35-9]|69[0-2]", "[1-9][0-9]{5,7}"),
    ("81", "[1-9][0-9]{8,9}"),
    ("82", "[1-9][0-9]{7,10}"),
    ("84", "[1-9][0-9]{8,9}"),
    ("85[02356]", "[1-9][0-9]{7,9}"),
    ("86", "1[3-9][0-9]{9}|[2-9][0-9]{8,9}"),
    ("88[06]", "[1-9][0-9]{7,9}"),
    ("90", "[2-58][0-9]{9}"),
    ("91", "[1-9][0-9]{9}"),
    ("92", "[1-9][0-9]{8,9}"),
    ("93", "[2-7][0-9]{8}"),
    ("94", "[1-9][0-9]{8}"),
    ("95", "[1-9][0-9]{6,9}"),
    ("96[0-8]", "[1-9][0-9]{6,9}"),
    ("97[0-7]", "[1-9][0-9]{6,9}"),
    ("98", "[1-9][0-9]{9}"),
    ("99[2-68]", "[1-9][0-9]{7,8}"),
)

# ---- End of fixed values.

# The default profanity lexicon, our choice: stems (category, severity from 1 to 3) and the endings each may take.
PROFANE_LEXICON: dict[str, tuple[str, int]] = {
    "arsehole": ("insult", 2),
    "asshole": ("insult", 2),
    "bastard": ("insult", 1),
    "bitch": ("insult", 2),
    "bollock": ("crude", 1),
    "bullshit": ("crude", 2),
    "cunt": ("sexual", 3),
    "dickhead": ("insult", 2),
    "fuck": ("sexual", 3),
    "motherfuck": ("sexual", 3),
    "piss": ("crude", 1),
    "prick": ("insult", 1),
    "shit": ("crude", 2),
    "slut": ("sexual", 3),
    "twat": ("sexual", 2),
    "wank": ("sexual", 2),
    "whore": ("sexual", 3),
}
PROFANE_STEMS: tuple[str, ...] = tuple(PROFANE_LEXICON)
PROFANE_ENDINGS: tuple[str, ...] = ("", "s", "es", "ed", "er", "ers", "ing", "in", "y")


def card_pattern() -> str:
    """One anchored regex over the digits: issuer prefix and length together."""
    parts = []
    for prefix, lengths in CARD_ISSUERS.values():
        low, _, high = lengths.partition("-")
        for alternative in prefix.split("|"):
            lead = len(re.sub(r"\[[^\]]*\]", "x", alternative))
            parts.append(f"{alternative}[0-9]{{{int(low) - lead},{int(high or low) - lead}}}")
    return "^(?:" + "|".join(parts) + ")$"


def iban_pattern() -> str:
    """One anchored regex for known country, check digits and account structure."""
    classes = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    parts = []
    for country, structure in IBAN_STRUCTURES.items():
        body = "".join(f"{classes[kind]}{{{n}}}" for n, kind in re.findall(r"(\d+)([nac])", structure))
        parts.append(f"{country}[0-9]{{2}}{body}")
    return "^(?:" + "|".join(parts) + ")$"


@lru_cache(maxsize=1)
def phone_world() -> str:
    """Regex over the digits of an international number: calling code and national number, not anchored."""
    planned: dict[str, list[str]] = {}
    for plan in PHONE_PLANS.values():
        trunk = f"(?:{plan.trunk})?" if plan.trunk else ""
        form = f"{trunk}(?:{plan.national})"
        if form not in planned.setdefault(plan.calling_code, []):
            planned[plan.calling_code].append(form)
    world = [f"{code}(?:{'|'.join(forms)})" for code, forms in planned.items()]
    for codes, national in PHONE_ABROAD:
        other = [c for c in map(str, range(20, 1000)) if re.fullmatch(codes, c) and c not in planned]
        if other:
            world.append(f"(?:{'|'.join(other)})0?(?:{national})")
    return "|".join(world)


def phone_national(region: str) -> str:
    """Regex over the digits of a number as written inside its region, with or without its calling code."""
    plan = PHONE_PLANS[region]
    trunk = f"(?:{plan.trunk})?" if plan.trunk else ""
    return f"{trunk}(?:{plan.national})|{plan.calling_code}(?:{plan.national})"


def phone_pattern(region: str | None) -> str:
    """Anchored regex over ``+`` and digits: any known country code, or the region's own forms."""
    if region is not None and region not in PHONE_PLANS:
        raise ValueError(f"no numbering plan for the region {region!r}")
    abroad = r"\+" if region is None else rf"(?:\+|{PHONE_PLANS[region].dial_out})"
    forms = [f"{abroad}(?:{phone_world()})"] + ([phone_national(region)] if region else [])
    return "^(?:" + "|".join(forms) + ")$"


def stretched(word: str) -> str:
    """Regex for a word in which any letter may be drawn out: ``f+u+c+k+``, but ``l{2,}`` for ``ll``."""
    parts = []
    for run in re.finditer(r"(.)\1*", word, re.DOTALL):
        n = len(run[0])
        parts.append(re.escape(run[1]) + ("+" if n == 1 else f"{{{n},}}"))
    return "".join(parts)


def profane_stem(stems=PROFANE_STEMS) -> str:
    """Regex for any of the stems, drawn out or not."""
    return "(?:" + "|".join(stretched(s) for s in stems) + ")"


def profane_search(stems=PROFANE_STEMS) -> str:
    """Finds the same texts as ``profane_stem``, in one pass whatever the text repeats.

    A match may begin at the last letters of a drawn-out first run, so a search needs no look behind: where the
    first two letters are not those of some stem, one look at two classes settles the place. The runs between are
    taken whole: what they could give back is the same letter, which no stem has next.
    """
    heads: dict[str, list[str]] = {}
    for stem in stems:
        first, *rest = (run[0] for run in re.finditer(r"(.)\1*", stem, re.DOTALL))
        tail = "".join(re.escape(run[0]) + (f"{{{len(run)},}}+" if len(run) > 1 else "++") for run in rest[:-1])
        tail += "".join(re.escape(char) for char in rest[-1]) if rest else ""
        heads.setdefault(first, []).append(tail)
    if not heads:
        return "(?:)"  # as without any alternative
    parts = ["".join(re.escape(char) for char in head) + f"(?:{'|'.join(tails)})" for head, tails in heads.items()]
    opening = "".join("[" + "".join(sorted({re.escape(stem[i]) for stem in stems})) + "]" for i in range(min(2, min(map(len, stems)))))
    return f"(?:(?={opening})(?:{'|'.join(parts)}))"


def profane_opening(stems=PROFANE_STEMS) -> str:
    """Finds each text in which a word begins with one of the stems, drawn out or not; upper case needs ``(?i)``.

    A place after a Latin letter begins no word.
    """
    parts = []
    for stem in stems:
        first, *rest = (run[0] for run in re.finditer(r"(.)\1*", stem, re.DOTALL))
        tail = "".join(re.escape(run[0]) + (f"{{{len(run)},}}+" if len(run) > 1 else "++") for run in (first, *rest)[:-1])
        parts.append(tail + "".join(re.escape(char) for char in (first, *rest)[-1]))
    if not parts:
        return "(?:)"  # as without any alternative
    heads = {re.escape(stem[0]) for stem in stems}
    seconds = heads | {re.escape(stem.lstrip(stem[0])[:1]) for stem in stems} - {""}
    opening = "[" + "".join(sorted(heads)) + "]" + ("[" + "".join(sorted(seconds)) + "]" if min(map(len, stems)) > 1 else "")
    return f"(?={opening})(?<![a-z])(?:{'|'.join(parts)})"


def profane_pattern(stems=PROFANE_STEMS, endings=PROFANE_ENDINGS) -> str:
    """Anchored regex over a folded word."""
    tails = "|".join(e for e in endings if e)
    return f"^{profane_stem(stems)}" + (f"(?:{tails})?$" if tails else "$")
