"""English stop words and the published Porter2 ("English") stemming algorithm, for one word at a time.

Words come from the tokenizer, lower-cased and free of apostrophes, so the apostrophe steps have nothing to do.
"""

import re

# The English stop words of the public Snowball list.
STOP_WORDS = frozenset("""
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing don down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will with
you your yours yourself yourselves
""".split())

# Words the rules do not apply to.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix rules, longest suffix first within a step.
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
]

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_REGION_EXCEPTION = re.compile("(gener|commun|arsen)")
_Y_AS_CONSONANT = re.compile("(^|[aeiouy])y")
_SHORT_END = re.compile("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE_END = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _region_start(word, start):
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word, suffixes):
    return next((s for s in suffixes if word.endswith(s)), None)


def _plural(word):
    suffix = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if suffix == "s" and _VOWEL.search(word, 0, len(word) - 2):
        return word[:-1]
    return word


def _participle(word, r1):
    suffix = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if suffix is None:
        return word
    stem = word[:len(word) - len(suffix)]
    if suffix.startswith("ee"):
        return stem + "ee" if len(stem) >= r1 else word
    if not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _DOUBLE_END.search(stem):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _SHORT_END.search(stem) else stem


def _derivation(word, r1):
    for suffix, other in STEP_2:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            blocked = (suffix == "ogi" and not stem.endswith("l")) or (
                suffix == "li" and not stem.endswith(tuple("cdeghkmnrt")))
            return word if len(stem) < r1 or blocked else stem + other
    return word


def _adjective(word, r1, r2):
    for suffix, other in STEP_3:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            return stem + other if len(stem) >= (r2 if suffix == "ative" else r1) else word
    return word


def _residue(word, r2):
    suffix = _ending(word, STEP_4)
    if suffix is None:
        return word
    stem = word[:len(word) - len(suffix)]
    if len(stem) < r2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _final_letter(word, r1, r2):
    stem = word[:-1]
    if word.endswith("e") and (len(stem) >= r2 or (len(stem) >= r1 and not _SHORT_END.search(stem))):
        return stem
    if word.endswith("ll") and len(stem) >= r2:
        return stem
    return word


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isalpha():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = _Y_AS_CONSONANT.sub(lambda m: m.group(1) + "Y", word)
    exception = _REGION_EXCEPTION.match(word)
    r1 = exception.end() if exception else _region_start(word, 0)
    r2 = _region_start(word, r1)
    word = _plural(word)
    if word in INVARIANT_AFTER_1A:
        return word
    word = _participle(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _derivation(word, r1)
    word = _adjective(word, r1, r2)
    word = _residue(word, r2)
    return _final_letter(word, r1, r2).lower()


def lexeme(word: str) -> str | None:
    """Stem of a word, or None for a stop word."""
    return None if word in STOP_WORDS else stem(word)
