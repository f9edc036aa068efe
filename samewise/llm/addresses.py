"""Reading postal addresses: house number, street, town, region and postcode of a free-text address."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from samewise.functions.dictionaries import ADDRESS, STATES

#: Further writings of the normaliser's street kinds, and kinds that it lacks (fixed values).
_WRITINGS = {
    "rd": "rd raod", "st": "st str", "ave": "ave aven avn", "dr": "dr drv", "ln": "ln la gali gully galli", "blvd": "blvd boul bld", "hwy": "hwy hiway", "ter": "ter terr", "ct": "ct crt", "pl": "pl",
    "marg": "marg mg maarg", "rue": "rue r", "ch": "chem", "all": "all", "imp": "imp", "crs": "crs", "qua": "qu q", "way": "way wy", "cir": "circle cir", "sq": "square sq", "pkwy": "parkway pkwy",
}
#: Street kinds and their writings.
KINDS = {k: sorted({*v.split(), *(w for w, short in ADDRESS.items() if short == k and w not in ("ali", "impase"))}) for k, v in _WRITINGS.items()}
KIND = {w: k for k, ws in KINDS.items() for w in ws}
#: Kinds that stand before the name of the street wherever they are used; others do so in France.
LEADING = {"rue", "ch", "all", "imp", "crs", "qua"}
#: Short writings that are a street kind only beside a number or a name, never inside one.
SHORT = {"r", "q", "la", "st", "av", "mg"}
#: What says where inside the building it is; the token behind goes with it.
UNITS = set("apt apartment appt suite ste unit flat fl floor flr bldg building bld office off shop godown room rm wing block blk tower bat batiment etage escalier esc bureau porte hall level lvl".split())
LANDMARK = set("near nr opp opposite behind beside bhd besides adjacent adj facing".split())
#: Words around a house number, and words that say nothing.
MARKERS = set("no num number plot door house h hno nos n° numero pin pincode zip cedex".split())
NOTHING = set("null none nan na n/a nil unknown - india us usa u.s. france united states".split())

#: Codes of regions that addresses use beside the normaliser's (fixed values: ISO 3166-2:IN writes Goa GA, addresses also OR for Odisha).
_MORE = {"us": {"dc"}, "india": {"or", "ct", "tg", "ut"}, "france": set()}
REGION_CODES = {land: {*names.values()} | _MORE[land] for land, names in STATES.items()}
#: Names of regions and their codes; a name of several countries' regions has the last one's.
_NAMES = {name: code for names in STATES.values() for name, code in names.items()}
_REGION = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _NAMES), key=len, reverse=True)).replace(r"\ ", "[ -]+") + r")\b")

_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_PIN = re.compile(r"(?<![\d#-])(\d{3})[ ]?(\d{3})(?![\d-])")
_ZIP = re.compile(r"(?<![\d#-])(\d{5})(?:-\d{4})?(?![\d])")
_UNIT_BEFORE = re.compile(r"\b(?:\d{1,2}(?:st|nd|rd|th|er|e|eme)|ground|first|second|third|top|upper|lower)[ ]+(?:fl|floor|flr|etage|level)\b\.?")
_UNIT = re.compile(r"\b(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b\.?[ ]*(?:(?:no|num|number)\b\.?[ ]*|#[ ]*)?(?:[a-z]{0,2}-?\d{1,3}[a-z]?|[a-z])\b(?![ ]*(?:" + "|".join(LEADING) + r")\b)")
_LANDMARK = re.compile(r"\b(?:near|nr|opp|opposite|behind|beside|besides|bhd|adjacent to|adj|facing|next to|in front of|pres de|derriere|face a)\b\.?[ ]*[a-z]+(?:[ ]+[a-z]+)?")
_MARK = re.compile(r"\b(?:h\.?[ ]?no|house[ ]no|plot[ ]no|door[ ]no|shop[ ]no|no|plot|door|num|numero)\b\.?[ ]*#?[ ]*(?=\d)|#[ ]*(?=\d)")
_DELIMITER = re.compile(r"[,;|/\n\r\t]+|[ ]-+[ ]|[ ]+-+(?=[ ]|$)")
_TOKEN = re.compile(r"[a-z0-9]+(?:['’.-][a-z0-9]+)*")
_FOLDS = (("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ee", "i"), ("oo", "u"), ("ou", "u"), ("y", "i"), ("w", "v"), ("z", "s"), ("ck", "k"), ("x", "ks"))
_DOUBLE = re.compile(r"([a-z])\1+")


def plain(text: str | None) -> str:
    """Lower case without accents and invisible characters."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_INVISIBLE).replace("–", " - ").replace("—", " - ").replace("ß", "ss").replace("œ", "oe").replace("æ", "ae").replace("ø", "o"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def fold(word: str, long_vowels: bool = True) -> str:
    """A key that spellings of one sound share: doubled letters, h behind a consonant, y for i and the like.

    A doubled vowel is another vowel's long form, or, without ``long_vowels``, a slip of the hand.
    """
    for a, b in _FOLDS:
        if a in word and (long_vowels or a not in ("ee", "oo", "ou")):
            word = word.replace(a, b)
    return _DOUBLE.sub(r"\1", word)


@dataclass(slots=True)
class Address:
    number: str = ""
    street: str = ""
    kind: str = ""
    town: str = ""
    region: str = ""
    postcode: str = ""
    #: The tokens behind the parts as they are written, each with its part's letter: ``n12 smain kstreet tspringfield p62701``.
    tokens: str = ""


def read_address(text: str | None, country: str | None = None) -> Address:
    """The parts of an address; what it does not have is ``''``. NULL, empty and blank give no part at all.

    Units, floors, wings, landmarks, country names and words for "missing" are left out. The street and the
    town are folded and written without spaces.
    """
    out = Address()
    s = plain(text).strip()
    if not s or s in NOTHING:
        return out
    land = plain(country).strip(" .")
    s = s.replace("n/a", " ").replace("p.o.", "po").replace("(", " , ").replace(")", " , ").replace('"', " ").replace("'", "").replace("’", "")
    s = _LANDMARK.sub(" , ", s)
    s = _UNIT_BEFORE.sub(" , ", s)
    s = _UNIT.sub(" , ", s)
    s = _MARK.sub(" #", s)
    found = _PIN.search(s) if not land.startswith(("us", "u.s", "uni", "fr")) else None
    found = found or _ZIP.search(s) or _PIN.search(s)
    if found:
        out.postcode = "".join(g for g in found.groups() if g)
        s = s[: found.start()] + " , " + s[found.end() :]
    s = _REGION.sub(lambda m: f" , ={_NAMES[re.sub('[ -]+', ' ', m[1])]} , ", s)
    parts = []
    for part in _DELIMITER.split(s):
        tokens = [t for t in re.findall(r"[#=]?[a-z0-9]+(?:[.-][a-z0-9]+)*", part)]
        tokens = [t.replace(".", "") for t in tokens if t not in NOTHING]
        tokens = [t for t in tokens if t and t not in MARKERS]
        if tokens:
            parts.append(tokens)
    codes = REGION_CODES["france"] if land.startswith("fr") else REGION_CODES["india"] if land.startswith("in") else REGION_CODES["us"] if land.startswith("u") else set().union(*REGION_CODES.values())
    places: list[str] = []
    groups: list[list[str]] = []
    alone, run_on, street_words, kind_word = -1, False, [], ""
    for tokens in parts:
        if tokens[0][0] == "=" or (len(tokens) == 1 and tokens[0] in codes):
            out.region = out.region or tokens[0].lstrip("=")
            continue
        if len(tokens) > 2 and tokens[-1] in codes and tokens[-1] not in KIND:
            out.region = out.region or tokens.pop()
        at = next((i for i, t in enumerate(tokens) if t[0] == "#" or t[0].isdigit()), -1)
        if at >= 0 and not out.number and len(tokens[at].lstrip("#")) <= 5:
            out.number = tokens[at].lstrip("#").lstrip("0") or "0"
        words = [t for t in tokens if not (t[0] == "#" or t[0].isdigit())]
        if not words:
            alone = len(groups) if alone < 0 and at >= 0 and not out.street else alone
            continue
        if out.street:
            places += words
            groups.append(words)
            continue
        kinds = [i for i, w in enumerate(words) if w in KIND]
        name: list[str] = []
        if kinds:
            k = kinds[0]
            french = KIND[words[k]] in LEADING or land.startswith("fr")
            if french and k == 0 and len(words) > 1:
                name, rest = words[1:], []
                if at > 0:  # the number divides street and town
                    cutoff = sum(1 for t in tokens[:at] if not t[0].isdigit())
                    name, rest = words[1:cutoff] or words[1:], words[cutoff:] if cutoff > 1 else []
            elif k == 0 and len(words) > 1 and len(kinds) == 1 and words[0] in SHORT:
                name, rest, k = [], words, -1  # a part such as "St Something" is no street kind
            else:
                later = [i for i in kinds if i > 0 and (words[i] not in SHORT or i == len(words) - 1 or len(kinds) == 1)]
                k = later[0] if later else kinds[-1]
                name, rest = words[:k], words[k + 1 :]
            if k >= 0:
                out.kind, kind_word = KIND[words[k]], words[k]
            name = [w for w in name if w not in ("main", "mn")] or name
        elif at >= 0 and out.number == tokens[at].lstrip("#").lstrip("0"):
            name, rest = words, []
            run_on = len(words) > 1
        else:
            rest = words
        if name:
            groups_name = street_words = name
            out.street = fold("".join(name).replace("-", ""))
        places += rest
        groups.append(rest)
    if run_on and not places:  # nothing divides street and town
        name = groups_name[:1]
        places = groups_name[1:]
        out.street = fold(name[0])
        street_words = name
    if not out.street and alone >= 0 and groups:
        # a number of its own and no street kind: the street is the part behind, or the only one before
        at = 0 if alone == 1 and groups[0] else alone if alone < len(groups) else -1
        if at >= 0:
            name = groups[at]
            if len(name) > 1 and not any(groups[at + 1 :]):
                name = name[:1]
            rest = groups[at][len(name) :]
            out.street = fold("".join(name).replace("-", ""))
            street_words = name
            places = [w for g in groups[:at] for w in g] + rest + [w for g in groups[at + 1 :] for w in g]
    town_words = [w for w in places if w not in ("main", "mn")]
    out.town = fold("".join(town_words).replace("-", ""))
    tokens = [("n", [out.number]), ("s", street_words), ("k", [kind_word]), ("t", town_words), ("r", [out.region]), ("p", [out.postcode])]
    out.tokens = " ".join(part + w.replace("-", "") for part, words in tokens for w in words if w)
    return out


#: Costs of the token alignment. A gap opens and is extended at these costs; what only one address has may cost
#: something besides. Above LIMIT two addresses differ.
GAP_OPEN, GAP_EXTEND, LIMIT = 0.25, 0.1, 1.75
#: Weights of the edits in a street, a town and a postcode, each as a share of its letters, and of differing kinds and regions.
STREET, TOWN, POSTCODE, KIND_COST, REGION_COST = 3.2, 2.4, 1.5, 0.7, 0.6
#: A word misread as one of the other part, a kind of street misspelt, and what can never be.
CROSSED, MISSPELT, NEVER = 0.3, 0.2, 99.0


@lru_cache(maxsize=1 << 16)
def _edits(a: str, b: str) -> int:
    from samewise.llm.names import edits

    return 0 if a == b else edits(a, b, max(1, max(len(a), len(b)) // 2))


@lru_cache(maxsize=1 << 16)
def _word(a: str, b: str) -> int:
    """Edits between two words, in the spelling of their sounds if that is nearer."""
    return min(_edits(a, b), _edits(fold(a), fold(b)))


def _share(a: str, b: str) -> float:
    """Edits between two words as a share of their length; swaps of neighbours count once."""
    return _edits(a, b) / max(len(a), len(b))


@lru_cache(maxsize=1 << 16)
def _kind_cost(word: str, kind: str) -> float:
    """The cost of ``word`` where a street kind is: nothing for a writing of the same kind in the dictionary, little for a misspelt one."""
    own = KIND.get(kind)
    if KIND.get(word) == own:
        return 0.0
    if any(len(w) > 2 and _edits(word, w) <= (1 if len(w) < 6 else 2) for w in KINDS.get(own, ())):
        return MISSPELT
    return KIND_COST if word in KIND else NEVER


def substitution(x: str, y: str, street: int, town: int) -> float:
    """The cost of aligning two tokens; ``street`` and ``town`` are the letters of the longer street and town.

    The abbreviation dictionaries make writings of one street kind equal; other words cost their edits.
    """
    p, q, a, b = x[0], y[0], x[1:], y[1:]
    if p == q:
        if a == b:
            return 0.0
        if p == "s":
            return STREET * _word(a, b) / street
        if p == "t":
            return TOWN * _word(a, b) / town
        if p == "k":
            return _kind_cost(a, b)
        if p == "r":
            return REGION_COST
        if p == "p":
            share = _share(a, b)
            return POSTCODE * share + (LIMIT if share > 0.4 else 0.0)
        return NEVER
    if {p, q} == {"s", "k"}:
        return _kind_cost(*((a, b) if q == "k" else (b, a)))
    if {p, q} == {"s", "t"}:
        return CROSSED + STREET * _word(a, b) / min(street, town)
    return NEVER


def _lost(token: str, street: int, town: int, there: set[str]) -> float:
    """What a token without a partner costs beside the gap; ``there`` are the parts that the other address has.

    A part that the other address lacks is merely missing. One that both have costs as much, left out on both sides, as
    the worst substitution, so differing parts are not passed off as missing ones.
    """
    part, size = token[0], len(token) - 1
    if part == "n":
        return NEVER
    if part == "s":
        return STREET * size / street
    if part not in there:
        return 0.0
    return {"t": TOWN / 2 * size / town, "k": KIND_COST / 2, "r": REGION_COST / 2, "p": LIMIT}[part]


def alignment_cost(a: str, b: str, most: float = NEVER) -> float:
    """Affine-gap alignment of two token sequences (see :attr:`Address.tokens`), by dynamic programming.

    Three tables hold the cheapest alignments that end in a pair of tokens, in a gap on the left or in one on the right: a
    run of missing tokens opens one gap. Two tokens may also align with one that is both run together. Ends early,
    with a cost above ``most``, once no alignment can stay within it.
    """
    x, y = a.split(), b.split()
    street = max(1, *(sum(len(t) - 1 for t in side if t[0] == "s") for side in (x, y)))
    town = max(1, *(sum(len(t) - 1 for t in side if t[0] == "t") for side in (x, y)))
    n, m = len(x), len(y)
    lose = [[_lost(t, street, town, {u[0] for u in other}) for t in side] for side, other in ((x, y), (y, x))]
    pair = [[NEVER] * (m + 1) for _ in range(n + 1)]
    left, right = [r[:] for r in pair], [r[:] for r in pair]
    pair[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                left[i][j] = lose[0][i - 1] + min(min(pair[i - 1][j], right[i - 1][j]) + GAP_OPEN, left[i - 1][j] + GAP_EXTEND)
            if j:
                right[i][j] = lose[1][j - 1] + min(min(pair[i][j - 1], left[i][j - 1]) + GAP_OPEN, right[i][j - 1] + GAP_EXTEND)
            if i and j:
                before = min(pair[i - 1][j - 1], left[i - 1][j - 1], right[i - 1][j - 1])
                best = before + substitution(x[i - 1], y[j - 1], street, town) if before <= most else NEVER
                if i > 1 and x[i - 2][0] == x[i - 1][0] == y[j - 1][0] and x[i - 1][0] in "st":
                    before = min(pair[i - 2][j - 1], left[i - 2][j - 1], right[i - 2][j - 1])
                    best = min(best, before + substitution(x[i - 2] + x[i - 1][1:], y[j - 1], street, town))
                if j > 1 and y[j - 2][0] == y[j - 1][0] == x[i - 1][0] and y[j - 1][0] in "st":
                    before = min(pair[i - 1][j - 2], left[i - 1][j - 2], right[i - 1][j - 2])
                    best = min(best, before + substitution(x[i - 1], y[j - 2] + y[j - 1][1:], street, town))
                pair[i][j] = best
        if i and min(*pair[i], *left[i], *right[i]) > most:
            return NEVER
    return min(pair[n][m], left[n][m], right[n][m])


def same_place(a: Address, b: Address) -> bool | None:
    """Whether two addresses denote one building or plot; None if one of them has no address.

    House number and street have to be there, and the alignment of all tokens to cost no more than ``LIMIT``, or
    seven tenths of it if neither town nor postcode is on both sides.
    """
    if not (a.street or a.town or a.postcode) or not (b.street or b.town or b.postcode):
        return None
    if not (a.number and b.number and a.street and b.street) or a.number != b.number:
        return False
    shared = (a.town and b.town) or (a.postcode and b.postcode)
    limit = LIMIT if shared else 0.7 * LIMIT
    return alignment_cost(a.tokens, b.tokens, limit) <= limit
