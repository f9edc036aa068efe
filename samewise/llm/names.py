"""Reading business names: the words that tell organisations apart, and the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from samewise.llm.addresses import fold, plain

#: Trade forms (fixed values).
FORMS = set("inc incorporated incorp corp corporation corpn co company cie llc llp lp ltd limited pvt private plc pte pty sarl sas sasu sa eurl sci snc gmbh ag bv nv prop proprietorship".split())
#: Words in front of a name that may be left out (fixed values).
LEADS = set("the shri shree sri sree ms messrs etablissements etablissement ets maison societe ste".split())
#: Trades and their short forms (fixed values).
TRADES = {
    "agencies": "agency agcy agcies", "associates": "associate assoc assocs", "bakery": "bkry bakers", "brothers": "bros brother", "builders": "bldrs builder",
    "chemicals": "chem chemical", "consultants": "conslt consulting consultancy", "daughters": "daughter dtrs", "dental": "dntl dentist", "distributors": "distr distributor dist",
    "electricals": "elec electrical electric", "engineering": "engg eng engineers", "enterprises": "entp enterprise ent", "foods": "fds food", "foundry": "fdry", "furniture": "furn",
    "hardware": "hdwe hdw", "industries": "inds industry ind", "international": "intl", "logistics": "logs logistic", "manufacturing": "mfg manufacturers", "motors": "mtrs motor",
    "nursery": "nsry", "packaging": "pkg packing", "pharmacy": "phcy pharma pharmacie", "printing": "prtg printers", "publishing": "pub publishers", "security": "sec", "services": "svcs service svc",
    "sons": "son", "technologies": "tech technology", "textiles": "text textile", "traders": "trdrs trading trader", "works": "", "store": "stores", "mart": "", "house": "", "point": "", "group": "grp",
    "holdings": "", "solutions": "", "systems": "", "partners": "", "supplies": "supply", "construction": "constr", "transport": "transports", "medical": "med", "school": "", "hotel": "", "restaurant": "", "cafe": "",
}
TRADE = {w: k for k, ws in TRADES.items() for w in [k, *ws.split()]}
#: Given names and what they are called for short (fixed values).
GIVEN = {
    "alexander": "alex alec sandy", "antoine": "ant anthony antony tony toine", "elizabeth": "beth liz lizzie betty eliza", "frederic": "fred frederick freddy", "james": "jim jimmy jas", "katherine": "kate kathy katie catherine kath",
    "krishna": "krsna kishan krishnan krish", "lakshmi": "luxmi laxmi lakshmy", "margaret": "maggie meg peggy peg marge", "michael": "mick mike mich mickey", "mohammed": "mohd md mohamed muhammad mohammad mohamad",
    "richard": "rich rick dick ricky", "robert": "bob rob bobby robt", "theodore": "ted theo teddy", "venkatesh": "venky venkat venkatesan", "william": "will bill wm billy willy", "john": "jon johnny", "joseph": "joe jos", "charles": "charlie chas",
    "thomas": "tom tommy thos", "george": "geo", "edward": "ed eddie ned", "david": "dave", "daniel": "dan danny", "mary": "marie maria", "anne": "ann anna", "jean": "", "pierre": "", "paul": "", "peter": "pete", "ram": "rama", "rajesh": "raj",
}
CALLED = {w: k for k, ws in GIVEN.items() for w in [k, *ws.split()]}
_JOIN = set("and et n und y of".split())
_ALIAS = re.compile(r"\b(?:d ?/ ?b ?/ ?a|t ?/ ?a|a ?/ ?k ?/ ?a|dba|trading as|doing business as|also known as|formerly)\b\.?[ ]*")
_DOMAIN = re.compile(r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)(?:\.[a-z]{2,10}){1,2}/?$")
_BRANCH = re.compile(r"[ ]+[-–—,][ ]*[^-–—,()]{2,40}?[ ]branch\b|\([^()]*\)")
_LETTERS = re.compile(r"\b[a-z](?:\. ?[a-z]\b)+\.?|\b[a-z](?: [a-z]){2,}\b")
_PLTD = re.compile(r"\bp\.? ?(?=ltd\b|limited\b)")
_WORD = re.compile(r"[a-z0-9]+(?:['’-][a-z0-9]+)*")


@dataclass(slots=True)
class Name:
    #: Distinctive words, folded, in their order; single letters are initials.
    words: tuple[str, ...] = ()
    #: The same words with doubled vowels read as slips; empty where nothing differs.
    soft: tuple[str, ...] = ()
    #: Given names, in full.
    given: tuple[str, ...] = ()
    #: Trades, in full.
    trades: tuple[str, ...] = ()
    #: Words of a trade name behind the legal name, folded and joined.
    alias: str = ""
    #: The name was a web address, so its words are not set apart.
    domain: bool = False


def read_name(text: str | None) -> Name:
    """What a name is made of. NULL, empty and blank have no words.

    Trade forms, words in front, remarks on the branch, quotes, case, accents and punctuation are left out.
    If nothing distinctive is left, the trades or given names are the words.
    """
    out = Name()
    s = plain(text).strip().strip("\"'“”‘’` ").strip(" ,.;")
    if not s:
        return out
    found = _DOMAIN.match(s)
    if found:
        out.words, out.domain = (fold(found[1].replace("-", "")),), True
        return out
    parts = _ALIAS.split(s, maxsplit=1)
    s = parts[0] or parts[-1]
    if len(parts) > 1:
        out.alias = "".join(fold(w) for w in _WORD.findall(parts[1]) if w not in FORMS)
    s = s.replace("m/s", " ")
    s = _BRANCH.sub(" ", s)
    s = _PLTD.sub("", s.replace("'s", "s").replace("’s", "s"))
    s = _LETTERS.sub(lambda m: re.sub(r"[. ]", "", m[0]) + " ", s)
    segments = [[w for t in _WORD.findall(seg.replace("&", " and ")) for w in re.split("['’-]", t) if w] for seg in s.split(",")]
    segments = [[w for w in seg if w not in FORMS] for seg in segments]
    segments = [seg for seg in segments if seg]
    if len(segments) > 1 and all(w in TRADE or w in _JOIN for w in segments[0]):
        segments = [*segments[1:], segments[0]]  # "Trades, The Name"
    named = [seg for seg in segments if not all(w in TRADE or w in _JOIN for w in seg)]
    if len(named) == 2:
        first, last = named
        trades_apart = [seg for seg in segments if seg not in named]
        if len(first) == 1 and len(last) > 1 and last[0] in LEADS:
            segments = [last, *trades_apart]  # "Town, The Name"
        elif not any(w in TRADE or w in CALLED for w in last) and not all(w in LEADS for w in last) and (any(w in TRADE for w in first) or len(first) > 1):
            segments = [first, *trades_apart]  # "Name Trades, Town"
    words, given, trades = [], [], []
    for w in (w for seg in segments for w in seg):
        if w in TRADE:
            trades.append(TRADE[w])
        elif w in CALLED and not given:
            given.append(CALLED[w])
        elif (w in _JOIN and (words or len(w) > 1)) or w == "the" or (w in LEADS and not words):
            continue
        else:
            words.append(w)
    out.words = tuple(f for w in words if (f := fold(w)))
    out.soft = tuple(f for w in words if (f := fold(w, False)))
    if out.soft == out.words:
        out.soft = ()
    out.given, out.trades = tuple(given), tuple(sorted(set(trades)))
    if not any(len(w) > 1 for w in out.words):
        out.words = out.words + tuple(fold(w) for w in given) or tuple(fold(w) for w in trades) or tuple(fold(w) for w in _WORD.findall(s))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from ``a`` to ``b``; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def word_edits(a: str, b: str) -> int:
    """Edits between two words that may be spellings of one; 9 if they can't be."""
    most = 0 if min(len(a), len(b)) < 3 else 1 if max(len(a), len(b)) < 6 else 2
    found = edits(a, b, most)
    return found if found <= most else 9


def same_name(a: Name, b: Name) -> bool | None:
    """Whether two names mean one organisation, in either reading of doubled vowels; None if one has no word."""
    found = _same_name(a, b)
    if found is False and (a.soft or b.soft):
        soft = [Name(x.soft or x.words, (), x.given, x.trades, x.alias, x.domain) for x in (a, b)]
        return _same_name(*soft)
    return found


def _initials_of(joined: str, other: Name) -> bool:
    """Whether an initial and a word are the beginning and the end of words run together."""
    initials, rest = [w for w in other.words if len(w) == 1], "".join(w for w in other.words if len(w) > 1)
    if len(initials) != 1 or len(rest) < 4 or len(joined) < len(rest) + 2 or joined[0] != initials[0]:
        return False
    return min(edits(joined[-n:], rest, 1) for n in (len(rest) - 1, len(rest), len(rest) + 1)) <= 1


def _same_name(a: Name, b: Name) -> bool | None:
    """Whether two names mean one organisation; None if one of them has no word.

    All distinctive words have to agree, in any order, run together or torn apart, up to single errors; an
    initial stands for a word or given name that begins with it. A shared word alone is not enough, and names that
    both state trades must have one in common.
    """
    if not a.words or not b.words:
        return None
    if a.trades and b.trades and not set(a.trades) & set(b.trades):
        return False  # the same words in another trade are another organisation
    if a.words == b.words:
        return True
    x, y = "".join(w for w in a.words if len(w) > 1), "".join(w for w in b.words if len(w) > 1)
    full = not any(len(w) == 1 for w in (*a.words, *b.words))
    most = max(len(x), len(y)) * 2 // 9
    if x and y and edits(x, y, most) <= most:
        if full:
            return True
        # words run together beside an initial: it has to stand for the other's given name or initial
        mine, theirs = ({w for w in z.words if len(w) == 1} for z in (a, b))
        if all(any(fold(g[0]) == w for g in b.given) for w in mine - theirs) and all(any(fold(g[0]) == w for g in a.given) for w in theirs - mine):
            return True
    if full and x and y and min(len(a.words), len(b.words)) == 1 and not (a.domain or b.domain):
        turned = "".join(reversed(a.words)), "".join(reversed(b.words))
        if edits(*turned, most) <= most or edits(x, turned[1], most) <= most or edits(turned[0], y, most) <= most:
            return True
    if a.domain or b.domain:  # a web address may join the words in another order, or leave some out
        web, other = (a, b) if a.domain else (b, a)
        rest = [w for w in other.words if len(w) > 1]
        if other.domain or not rest:
            return False
        joined = {"".join(rest), "".join(reversed(rest)), "".join([*(fold(g) for g in other.given), *rest]), "".join([*rest, *map(fold, other.trades)])}
        if any(edits(web.words[0], j, len(j) * 2 // 9) <= len(j) * 2 // 9 for j in joined):
            return True
        return _initials_of(web.words[0], other)
    for one, other in ((a, b), (b, a)):
        if len(one.words) == 1 and len(one.words[0]) > 8 and _initials_of(one.words[0], other) and set(a.trades) & set(b.trades):
            return True
    left, right = list(a.words), list(b.words)
    matched, total = 0, 0
    for w in [w for w in a.words if len(w) > 1]:
        found, v = min(((word_edits(w, v), v) for v in right if len(v) > 1), default=(9, ""))
        if found < 9:
            left.remove(w)
            right.remove(v)
            matched += 1
            total += found
    if not left and not right:
        order = [w[0] for w in a.words] == [w[0] for w in b.words]
        return 0 < matched and total <= (3 if order else 2)
    if not matched or total > 2 or (matched == 1 and total > 1):
        return False
    # what is left over has to be explained by initials
    for mine, theirs, given in ((left, right, b.given), (right, left, a.given)):
        for w in [w for w in mine if len(w) == 1]:
            hit = next((v for v in theirs if v[0] == w), None)
            if hit is not None:
                theirs.remove(hit)
                mine.remove(w)
            elif any(fold(g[0]) == w for g in given):
                mine.remove(w)
    return not left and not right and (bool(set(a.trades) & set(b.trades)) or not a.trades or not b.trades)
