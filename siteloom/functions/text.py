"""Text column expressions: mark-up, numbers in prose, query rewriting."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# State abbreviations, matched in capitals only.
STATES = {
    "MP": "Madhya Pradesh", "TN": "Tamil Nadu", "AP": "Andhra Pradesh", "UP": "Uttar Pradesh", "TG": "Telangana", "MH": "Maharashtra", "RJ": "Rajasthan", "KA": "Karnataka", "KL": "Kerala",
    "WB": "West Bengal", "GJ": "Gujarat", "HP": "Himachal Pradesh", "JK": "Jammu and Kashmir",
}
# Misspellings, matched in any case.
TYPOS = {
    "Suzion": "Suzlon", "Suzlan": "Suzlon", "Suzolon": "Suzlon", "Vesta": "Vestas", "Siemens Gamesa": "Siemense Gamesa", "Gamesia": "Gamesa", "Inox": "Inox",
    "Gujrat": "Gujarat", "Maharastra": "Maharashtra", "Maharasthra": "Maharashtra", "Karnatka": "Karnataka", "Karnatak": "Karnataka", "Tamilnadu": "Tamil Nadu", "Tamil nadu": "Tamil Nadu",
    "Telangna": "Telangana", "Telengana": "Telangana", "Andra Pradesh": "Andhra Pradesh", "Madhyapradesh": "Madhya Pradesh", "Madhya pradesh": "Madhya Pradesh", "Rajstan": "Rajasthan", "Rajashtan": "Rajasthan",
    "Uttarpradesh": "Uttar Pradesh", "Uttar pradesh": "Uttar Pradesh", "Himachalpradesh": "Himachal Pradesh", "West bengal": "West Bengal", "Westbengal": "West Bengal", "Orissa": "Odisha",
}
# Terms whose longer form is appended.
EXPANSIONS = {
    "mast": "wind monitoring mast", "masts": "wind monitoring masts", "WEG": "Wind Energy Generator", "WEGs": "Wind Energy Generators", "WTG": "Wind Turbine Generator", "WTGs": "Wind Turbine Generators",
    "capacity": "installed capacity", "manufacturer": "WEG manufacturer", "turbine": "wind turbine generator WEG", "turbines": "wind turbine generators WEGs",
}
# Makers and states whose mention asks for tables of their own.
MAKERS = [
    "Suzlon", "Vestas", "GE", "Envision", "Senvion", "Inox", "Adani Green", "Adani", "Siemense Gamesa", "Gamesa", "Sany",
    "Pioneer Wincon", "Pioneer", "SIVA Wind", "SIVA", "Nordex", "Regen Powertech", "Regen", "WEG Electric", "Emergya Wind",
]
FULL_STATES = ["Andhra Pradesh", "Gujarat", "Karnataka", "Maharashtra", "Tamil Nadu", "Madhya Pradesh", "Rajasthan", "Telangana", "Kerala", "West Bengal", "Odisha", "Goa", "Uttar Pradesh", "Himachal Pradesh"]
# What is put before a query that asks for a table, by what the query mentions.
VARIANTS = [
    ("maker and year", "Manufacturer-wise capacity addition contribution MW during the year "),
    ("maker and year", "Make and Year-wise WEG Installations in India table by manufacturer for FY year "),
    ("maker and state", "State and Make-wise WEG Installations table by manufacturer and state "),
    ("maker alone", "Manufacturer cumulative total installations and FY 2024-25 contribution MW summary "),
    ("maker alone", "State and Make-wise WEG Installations cumulative total by manufacturer "),
    ("mast", "NIWE total wind monitoring masts installed locations India "),
    ("share", "Important facts and figures of Indian windpower percentage of estimated potential "),
    ("how many makers", "List of WEG manufacturers offering wind electric generators in India ratings hub heights total models active "),
]
# Items about wind, and the class of a press release by the first pattern in its title.
WIND = r"wind|turbine|\bwtg\b|offshore|repower|niwe|fdre|suzlon|inox|gamesa|vestas|nordex|envision|gwec|senvion|jsw\s*energy|adani\s*green|renew\s*power|serentica|ayana"
RELEASES = [("wind", "Wind"), ("offshore", "Offshore"), ("repow", "Repowering")]
# Which tenders count, and their class by the first pattern.
TENDERS_KEPT = r"\bwind\b|\b(hybrid|fdre|rtc|round[- ]the[- ]clock)\b"
TENDERS = [("offshore", "Offshore Wind"), ("repower", "Repowering"), ("fdre", "FDRE"), ("rtc|round[- ]the[- ]clock", "RTC"), ("hybrid", "Wind-Solar Hybrid")]


def ascii_words(pattern: str) -> str:
    """``pattern`` with word boundaries that count only ASCII letters, digits and underscores.

    Before a letter, digit or bracket a boundary starts a word, else it ends one;
    where a sign may stand between two, it is written out in full.
    """
    if "%" in pattern:
        return pattern.replace(r"\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")
    starts = re.sub(r"\\b(?=[A-Za-z0-9(\[]|\\d)", "(?<![A-Za-z0-9_])", pattern)
    return starts.replace(r"\b", "(?![A-Za-z0-9_])")


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and comments gone, tags to spaces, entities decoded, spaces run together."""
    out = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def sql_strip_html(html: str) -> str:
    out = f"regexp_replace({html}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs')"
    out = f"regexp_replace({out}, '<!--.*?-->', ' ', 'gs')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for name, value in ENTITIES:
        out = f"replace({out}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'))"


def rated_kw(raw: Column) -> Column:
    """Kilowatts from '2.5 MW', '850 kW', '1 GW', '900000 W', or a bare number (watts from 10000 up)."""
    value = F.regexp_extract(raw, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, r"[0-9.]+ *([A-Za-z]*)", 1))
    return F.when(unit == "gw", value * 1e6).when(unit == "mw", value * 1e3).when(unit == "kw", value).when((unit == "w") | (value >= 10000), value / 1e3).otherwise(value)


def max_voltage(raw: Column) -> Column:
    """The largest positive number of a list parted by semicolons; null if there is none."""
    values = F.transform(F.split(raw, ";"), lambda x: F.trim(x).try_cast("double"))
    return F.array_max(F.filter(values, lambda x: x > 0))


def with_states(query: Column) -> Column:
    """State abbreviations spelled out; queries without any pass by the rules."""
    out = reduce(lambda q, s: F.regexp_replace(q, f"(?<![A-Za-z]){s[0]}(?![A-Za-z])", s[1]), STATES.items(), query)
    return F.when(query.rlike(f"({'|'.join(STATES)})"), out).otherwise(query)


def mended(query: Column) -> Column:
    """Typing errors mended, white space cut from both ends; queries without any error pass by the rules."""
    out = reduce(lambda q, t: F.regexp_replace(q, "(?i)" + ascii_words(rf"\b{t[0]}\b"), t[1]), TYPOS.items(), query)
    return F.regexp_replace(F.when(query.rlike(f"(?i)({'|'.join(TYPOS)})"), out).otherwise(query), r"^\s+|\s+$", "")


def expanded(canonical: Column) -> Column:
    """The query with the longer forms of its terms in brackets, unless it holds them."""
    more = F.array_compact(F.array(*[F.when(canonical.rlike(ascii_words(rf"\b{k}\b")) & ~F.contains(F.lower(canonical), F.lit(v.lower())), v) for k, v in EXPANSIONS.items()]))
    return F.when(F.size(more) == 0, canonical).otherwise(F.concat(canonical, F.lit(" ("), F.array_join(more, "; "), F.lit(")")))


# What tells that a query mentions a thing.
MENTIONS = {
    "maker": "(?i)" + rf"\b({'|'.join(MAKERS)})\b",
    "year": r"\b(FY|fiscal|20\d{2}|20\d{2}[-–]\d{2})\b",
    "state": "(?i)" + "|".join(FULL_STATES),
    "mast": r"(?i)\bmast(s)?\b|\bmonitoring\b",
    "share": r"(?i)\b(percent|percentage|%|share|ratio|potential)\b",
    "how many": r"(?i)\bhow many\b",
    "makers": r"(?i)\b(manufacturer|maker|company|companies|vendors?)\b",
}


def mentions(canonical: Column) -> Column:
    """What the query mentions, a flag each."""
    return F.struct(*[canonical.rlike(ascii_words(v)).alias(k) for k, v in MENTIONS.items()])


def variants(canonical: Column, has: Column) -> Column:
    """Other forms of the query, each of which aims at one table of the corpus, by what it mentions."""
    when = {"maker and year": has["maker"] & has["year"], "maker and state": has["maker"] & has["state"], "maker alone": has["maker"] & ~has["year"] & ~has["state"], "mast": has["mast"], "share": has["share"], "how many makers": has["how many"] & has["makers"]}
    return F.array_compact(F.array(*[F.when(when[k], F.concat(F.lit(lead), canonical)) for k, lead in VARIANTS]))


def first_match(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern found in ``text`` in any case."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + ascii_words(p)), name) for p, name in rules], F.lit(other))


def sql_first_match(text: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{name}'" for p, name in rules) + f" ELSE '{other}' END"

#: Districts by other spellings, older names and places in them, by their letters; and what a text that names several districts holds.
DISTRICT_ALIASES = {
    "anantapuram": "anantapur", "ananthapuram": "anantapur", "ananthapuramu": "anantapur", "anantpur": "anantapur", "anantpuram": "anantapur", "anantpurum": "anantapur",
    "anathapuramu": "anantapur", "kadappah": "cuddapah", "kodappah": "cuddapah", "ysrkadapa": "cuddapah", "yskadapa": "cuddapah", "kadapa": "cuddapah",
    "bhoynagor": "bhavnagar", "bhuj": "kachchh", "kutch": "kachchh", "devbhumidwarka": "jamnagar", "devbhumidwrk": "jamnagar", "devbhoomidwrk": "jamnagar",
    "dwarka": "jamnagar", "khambaliya": "jamnagar", "kariyana": "rajkot", "kalawad": "jamnagar", "babra": "amreli", "porbander": "porbandar",
    "surendemagar": "surendranagar", "surendernagar": "surendranagar", "dharampur": "valsad", "morbi": "rajkot", "botad": "bhavnagar", "godag": "gadag",
    "tumkar": "tumkur", "belgavi": "belgaum", "belagavi": "belgaum", "ballari": "bellary", "vijayapura": "bijapur", "vijayapr": "bijapur", "vijayanagar": "bellary",
    "vijayanagara": "bellary", "vijaynagar": "bellary", "kopal": "koppal", "kopol": "koppal", "davengere": "davangere", "darwad": "dharwad", "gulburga": "gulbarga",
    "kalaburagi": "gulbarga", "sandur": "bellary", "dhajpur": "shajapur", "jaora": "ratlam", "dharashiv": "osmanabad", "yavotmal": "yavatmal", "sanghli": "sangli",
    "jaiselmer": "jaisalmer", "tuticorin": "thoothukudi", "thoothukkudi": "thoothukudi", "thoolthukudi": "thoothukudi", "tirunelveli": "tirunelvelikattabo",
    "tiruneveli": "tirunelvelikattabo", "tirupur": "coimbatore", "thirupur": "coimbatore", "tiruppur": "coimbatore", "tirupu": "coimbatore", "udumalpet": "coimbatore",
    "ramnad": "ramanathapuram", "muppandal": "kanniyakumari", "kayathor": "thoothukudi", "tenkasi": "tirunelvelikattabo", "dharampuri": "dharmapuri",
    "rangareddi": "rangareddy", "kerala": "palakkad", "kerla": "palakkad",
}
SEVERAL_DISTRICTS = r"[&/,]| and |\+"
