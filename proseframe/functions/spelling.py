"""British spelling, the -ize preference, and consistent foreign words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_matches, is_acronym_ratio, lit_map, replace_each

# American spellings and their British forms.
US_UK = {
    "color": "colour", "colors": "colours", "colored": "coloured", "coloring": "colouring",
    "favorite": "favourite", "favorites": "favourites",
    "behavior": "behaviour", "behaviors": "behaviours",
    "honor": "honour", "honors": "honours", "honorable": "honourable",
    "labor": "labour", "neighbor": "neighbour", "neighbors": "neighbours",
    "vigor": "vigour",
    "center": "centre", "centers": "centres",
    "meter": "metre", "meters": "metres",
    "liter": "litre", "liters": "litres",
    "fiber": "fibre",
    "defense": "defence", "pretense": "pretence",
    "traveling": "travelling", "traveled": "travelled", "traveler": "traveller", "travelers": "travellers",
    "catalog": "catalogue", "dialog": "dialogue",
    "jewelry": "jewellery",
    "aluminum": "aluminium",
    "tire": "tyre",
    "curb": "kerb",
}
# Families of words beyond that table, each with its rule. Stems as written in American spelling, without the part that changes.
OUR = "arb ard arm cand clam demean endeav fav ferv flav harb hum od parl ranc rum sav savi splend succ tum val vap misdemean dishon discol disfav belab unsav".split()
OUR_TABLE = "col hon lab neighb behavi vig".split()  # of the table above, with more endings
OUR_ENDS = "s|ed|ing|able|ably|er|ers|ful|fully|less|ite|ites|al|hood|hoods|ly"
RE = "cent centimet millimet kilomet epicent fib lit millilit theat somb lust scept spect sab calib meag sepulch och".split()
OGUE = "anal catal dial monol prol epil travel".split()
ENSE = "def off pret".split()
DOUBLED = "cancel channel counsel dial dishevel duel enamel fuel funnel grovel impanel label level libel marvel model panel pedal pencil quarrel refuel revel rival shovel signal snorkel spiral stencil total travel tunnel unravel".split()
YSE = "anal catal paral electrol hydrol psychoanal breathal".split()
# Single words that follow no rule.
SINGLE = {
    "aging": "ageing", "airplane": "aeroplane", "airplanes": "aeroplanes", "artifact": "artefact", "artifacts": "artefacts", "cozy": "cosy", "diarrhea": "diarrhoea", "enroll": "enrol", "enrollment": "enrolment", "enrollments": "enrolments", "enrolls": "enrols",
    "fulfill": "fulfil", "fulfillment": "fulfilment", "fulfills": "fulfils", "gray": "grey", "grays": "greys", "hemoglobin": "haemoglobin", "installment": "instalment", "installments": "instalments", "leukemia": "leukaemia",
    "maneuver": "manoeuvre", "maneuvered": "manoeuvred", "maneuvering": "manoeuvring", "maneuvers": "manoeuvres", "mold": "mould", "molds": "moulds", "mustache": "moustache", "orthopedic": "orthopaedic", "pajamas": "pyjamas", "pediatric": "paediatric", "plow": "plough", "plowed": "ploughed", "plowing": "ploughing", "plows": "ploughs",
    "skeptic": "sceptic", "skeptical": "sceptical", "skepticism": "scepticism", "skeptics": "sceptics", "skillful": "skilful", "skillfully": "skilfully", "sulfur": "sulphur", "willful": "wilful", "willfully": "wilfully",
}
#: (pattern of a whole word in lower case, what it becomes)
FAMILIES = [
    (rf"({'|'.join(OUR + OUR_TABLE)})or({OUR_ENDS})?", "$1our$2"), (rf"({'|'.join(RE)})er(s)?", "$1re$2"), (rf"({'|'.join(RE)})er(ed|ing)", "$1r$2"), (rf"({'|'.join(OGUE)})og(s)?", "$1ogue$2"), (rf"({'|'.join(OGUE)})og(ed|ing)", "$1ogu$2"),
    (rf"({'|'.join(ENSE)})ense(s|less)?", "$1ence$2"), (rf"({'|'.join(DOUBLED)})(ed|ing|er|ers|ings)", "$1l$2"), (rf"({'|'.join(YSE)})yz(e|es|ed|ing|er|ers)", "$1ys$2"),
]
# Words whose -ize stays.
STAY_IZE = [f"{w}{e}" for w in ("capsiz", "seiz", "priz", "siz") for e in ("e", "es", "ed", "ing")]
# Names of bodies that keep their own spelling.
ORGANISATIONS = ["World Health Organization", "World Trade Organization", "International Civil Aviation Organization"]
# Foreign words and their variants.
FOREIGN = {"Ulema": ["Ulamaa", "Uluma", "Ulama"], "Shia": ["Shiite", "Shiah", "Shi'a", "Shi‘a"]}
IZE = r"(?:ize|izes|ized|izing|ization|izations)"
ISE = r"(?:ise|ises|ised|ising|isation|isations)"


def keep_case(new: Column, old: Column) -> Column:
    return F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).when(F.upper(F.substring(old, 1, 1)) == F.substring(old, 1, 1), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1000))).otherwise(new)


def prefers_ize(text: Column) -> Column:
    """Whether -ize is the text's own choice: at least 8 of them, and 1.8 times as many as -ise."""
    ize, ise = count_matches(text, rf"\b[a-z]+{IZE}\b"), count_matches(text, rf"\b[a-z]+{ISE}\b")
    return ize >= F.greatest(F.lit(8), F.floor(F.greatest(F.lit(1), ise) * 1.8))


def british_word(word: Column, keep_ize: Column | None = None) -> Column:
    """One word in British spelling: the table, the families of words, then -ization and -ize; acronyms stay."""
    low = F.lower(word)
    family = low
    for pattern, to in FAMILIES:
        family = F.regexp_replace(family, f"^{pattern}$", to)
    any_family = "|".join(p.replace("(", "(?:") for p, _ in FAMILIES)
    known = F.coalesce(F.element_at(lit_map(US_UK | SINGLE), low), F.when(low.rlike(f"^(?:{any_family})$"), family))
    ised = F.regexp_replace(F.regexp_replace(low, r"iz(ations?)$", "is$1"), r"iz(e|es|ed|ing|er|ers)$", "is$1")
    suffix = low.rlike(r".{2}iz(?:ations?|e|es|ed|ing|er|ers)$") & ~low.isin(*STAY_IZE)
    if keep_ize is not None:
        suffix = suffix & ~keep_ize
    return F.when(is_acronym_ratio(word) & (F.length(word) < 5), word).when(known.isNotNull(), keep_case(known, word)).when(suffix, keep_case(ised, word)).otherwise(word)


def british(text: Column, keep_ize: Column | None = None) -> Column:
    """British spelling throughout; the names of listed bodies stay."""
    bodies = "|".join(ORGANISATIONS)
    return replace_each(text, rf"(?i:{bodies})|(?<![\p{{L}}\p{{N}}_])[A-Za-z]+(?![\p{{L}}\p{{N}}_])", lambda w: F.when(w.contains(" "), w).otherwise(british_word(w, keep_ize)))


def _cased(word: str) -> Callable[[Column], Column]:
    return lambda m: F.when(F.upper(m) == m, F.lit(word.upper())).when(F.lower(m) == m, F.lit(word.lower())).otherwise(F.lit(word))


def consistent_foreign(text: Column) -> Column:
    """One spelling of each listed foreign word, in the case it was written."""
    for word, variants in FOREIGN.items():
        pattern = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(variants) + r")(?![\p{L}\p{N}_])"
        text = replace_each(text, pattern, _cased(word))
    return text


# Words that hint at a foreign phrase.
FOREIGN_CUES = ("Abhiyan", "Yatra", "Sangh", "Sabha", "ayatollah", "madrasa", "shura", "qazi", "ulema")


def looks_foreign(text: Column, cues: tuple[str, ...] = FOREIGN_CUES) -> Column:
    """Whether a text is worth asking about foreign words: any non-ASCII character, or a cue."""
    return text.rlike(r"[^\x00-\x7F]") | text.rlike(r"(?i)\b(?:" + "|".join(cues) + r")\b")


def near_protected_name(text: Column, start: Column, end: Column, reach: int = 60) -> Column:
    """Whether a listed body's name stands within reach of the place [start, end), counted from 0."""
    a = F.greatest(start - reach, F.lit(0))
    window = F.lower(text.substr((a + 1).cast("int"), (end + reach - a).cast("int")))
    hit = F.lit(False)
    for n in ORGANISATIONS:
        hit = hit | window.contains(n.lower())
    return hit
