"""Personal information in free text by a semi-Markov conditional random field.

Candidate segments (spans of characters with a type) are proposed by form, names by how their words are written; whole-span
features, such as the form, the pattern of a name's words and the words around the span, give each a weight. The best set of
segments that don't overlap is found by dynamic programming over their ends, with segments of bounded
length, so that boundaries and types are chosen together. The weights are fitted by maximum
likelihood, with the forward and backward sums over the same segments, on ``TRAINING`` sentences made from the
templates below. There is no list of names: names in training are coined, or taken from the words that a public tokenizer's vocabulary has;
what it has in small letters is an ordinary word, and that is one feature among others. No sentence of the collection is in the templates.

Forms are tried only around something that can begin a segment of one; whatever they propose in the whole text lies in such a stretch.
"""

from __future__ import annotations

import json
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import accumulate, chain, repeat
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
TRAINING, PASSES, SEED = 20_000, 3, 7
#: Characters around a trigger in which forms are tried.
AROUND = 70
#: Words of a name, and those at most that may join two of its parts.
NAME_WORDS, JOINING = 4, 3
#: Names written small are that much rarer (as log odds) in texts than in the training sentences, among all words that could be one.
SMALL_PRIOR = 3.0
#: So are ordinary words with a capital alone.
ORDINARY_PRIOR = 1.0

# Types of streets and units.
STREETS = "street st avenue ave road rd lane ln drive dr terrace ter court ct place pl boulevard blvd way circle cir square sq parkway pkwy highway hwy row crescent close alley trail".split()
UNITS = "unit apt apartment suite ste flat room rm".split()
# Small words inside names.
PARTICLES = frozenset("de la del della di da das do dos du van von der den ten ter al el bin ibn ben af av zu le".split())
# Classes of words around names.
AROUND_NAMES = {
    "role": """server waiter waitress bartender barkeep host hostess manager chef cook owner barista busser busboy runner sommelier cashier clerk greeter
        maitre captain attendant supervisor doorman valet driver courier baker butcher assistant employee staffer boss guide singer pianist technician nurse
        doctor teacher coach agent director receptionist proprietor landlord""",
    "kin": """cousin sister brother mother father mom mum dad aunt uncle niece nephew grandma grandmother grandpa grandfather wife husband son daughter friend friends
        buddy pal neighbor neighbour roommate colleague coworker boyfriend girlfriend fiance fiancee partner twin classmate""",
    "title": "mr mrs ms miss mister madam sir dr prof professor señor señora monsieur madame mx",
    "thanks": "thanks thank kudos props cheers bravo credit shout shoutout congrats congratulations applause love hugs regards sincerely yours dear hi hello hey hail",
    "called": "called named call name meet met ask asked tell told see saw know knew remember remembered",
    "place": "in at near from around outside toward towards across downtown visiting visit north south east west central",
    "spot": """cafe café grill kitchen bistro diner bar pub tavern house restaurant eatery deli bakery pizzeria market mall plaza hotel inn airport park bridge beach hill hills
        valley county river lake city town village station university college festival church theater theatre museum bay heights club lounge steakhouse
        brewery tower district island field stadium lake mount fort san saint little upper lower square beach coast mountain ocean airport""",
    "does": """was is were who whose he she took takes brought brings helped helps greeted seated kept poured served made makes gave gives told tells said says smiled
        explained offered remembered came comes handled checked apologized apologised recommended suggested refilled rocks went ran listened laughed wrote
        called answered ordered wanted loved likes liked had has did does can will would always never even also""",
    "day": """monday tuesday wednesday thursday friday saturday sunday mondays tuesdays wednesdays thursdays fridays saturdays sundays january february march april may june july august september october november december
        christmas easter thanksgiving halloween spring summer autumn winter""",
    "nation": """american italian french spanish mexican chinese japanese korean thai vietnamese indian greek turkish german english irish british polish russian cuban
        brazilian peruvian african asian european mediterranean caribbean moroccan lebanese ethiopian portuguese cajun southern western""",
    "determiner": "the a an this these those some any every each no another one its",
    "possessive": "my our his her their your",
    "picture": "photo photos picture pictures portrait poster painting drawing sketch mural statue image selfie",
    "link": "and with that through for by of to on about under plus or but as after before when while because if so than",
}

_AT = r"(?:\s*@\s*|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_STREET = "|".join(STREETS)
_UNIT = rf"(?:(?:{'|'.join(UNITS)})\.?\s*#?\s*|#\s*)\d{{1,5}}[a-z]?"
_ROAD = rf"\d{{1,5}}[a-z]?\s+(?:[^\W\d_][\w'’.-]*\s+){{1,3}}(?:{_STREET})\b"
#: Forms of the segments: type, name of the form, pattern. Each is tried at every place.
FORMS = [
    (kind, name, re.compile(rf"(?<![\w])(?=({pattern}))", re.IGNORECASE))
    for kind, name, pattern in (
        ("email", "plain", r"[\w.+-]+@[\w-]+(?:\.[\w-]*\w)+"),
        ("email", "written", rf"[\w.+-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]*\w)+"),
        ("phone", "area", r"\(\d{3}\)[-. ]?\d{3}[-. ]?\d{4}(?!\d)"),
        ("phone", "ten", r"\d{3}[-./ ]?\d{3}[-. ]?\d{4}(?![\d-])"),
        ("phone", "seven", r"\d{3}[-. ]\d{4}(?![\d-])"),
        ("phone", "abroad", r"\+\d{1,3}(?:[-. ]?\(?\d{2,4}\)?){2,4}(?![\d-])"),
        ("phone", "trunk", r"0\d{2,4}[-. ]\d{3,4}[-. ]\d{3,4}(?![\d-])"),
        ("id_number", "parts", r"\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"),
        ("id_number", "short", r"\d{2}-\d{7}(?![\d-])"),
        ("id_number", "plain", r"\d{8,10}(?![\d-])"),
        ("id_number", "letters", r"[a-z]{1,3}\d{6,9}(?![\w-])"),
        ("id_number", "groups", r"[a-z]?\d{3}-\d{4}-\d{4}(?![\w-])"),
        ("id_number", "mixed", r"(?=[a-z-]*\d)[a-z0-9]+(?:-[a-z0-9]+)*(?=\W|\Z)"),
        ("street_address", "road", _ROAD),
        ("street_address", "unit first", rf"{_UNIT},?\s+{_ROAD}"),
        ("street_address", "unit last", rf"{_ROAD}\.?,?\s+{_UNIT}"),
    )
]
_TOKEN = re.compile(r"\w++(?:['’-](?![sS]\b)[^\W\d_]++)*+|[^\w\s]")
_NUMBER = re.compile(r"\d[\d\-. ()/]*")
# What begins a segment of some form, at least: "+12345" is the shortest number, others are road numbers or mixed.
_LEAST_NUMBER, _LEAST_MIXED = 5, 7
_ROAD_AFTER = re.compile(rf"[a-z]?\s+(?:[^\W\d_][\w'’.-]*\s+){{1,3}}(?:{_STREET})\b(?:\.?,?\s+{_UNIT})?", re.IGNORECASE)
_MIXED = re.compile(r"\d[a-z0-9-]*", re.IGNORECASE)
_AT_WORD = re.compile(r"[@aA](?:(?<=@)|(?<=[\s\[(][aA])[tT](?!\w))")
# Without either, no place follows.
_POINT = re.compile(r"\.[\w-]")
_DIGIT = re.compile(r"\d")
_PLACE_AFTER = re.compile(rf"\s*[\])]?\s*[\w-]+(?:{_DOT}[\w-]*\w)+", re.IGNORECASE)


@dataclass(frozen=True, eq=False)
class Words:
    """What a public tokenizer's vocabulary says of words: those that it has written small (more often than with a capital), and those with one."""

    small: frozenset[str]
    capital: frozenset[str]


@lru_cache
def known_words(path: str) -> Words:
    """Whole words of the vocabulary. Of a word that it has both ways, the one that it learned first, the more frequent, counts."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {w[1:]: n for w, n in vocabulary.items() if w[0] == "Ġ" and w[1:].isalpha()}
    lows = {w.lower() for w in ranks}
    never = len(vocabulary)
    small = {w for w in lows if ranks.get(w, never) <= ranks.get(w.capitalize(), never)}
    return Words(frozenset(w for w in small if w in ranks), frozenset(w for w in lows - small if w.capitalize() in ranks))


#: Before a name that is written small, and what no such name ends at.
_EXPECT = frozenset(["role", "kin", "title", "thanks", "called"])
_NOT_AFTER = frozenset(["w", "u", "W", "U", "9", "does", "possessive", "determiner", "place", "spot", "day"])
_GOES_ON = frozenset(["w", "u", "W", "U", "determiner", "possessive", "place", "spot", "role", "kin", "day"])
#: So many characters that long a row of words in capitals has, at least.
_NO_SMALL = re.compile(r"[^a-zß-öø-ÿ][^a-zß-öø-ÿ]{11}")
#: The kinds of words in capitals.
_CAPITALS = frozenset(["iT", "kA", "uA", "pA"])
_CLASS = {w: c for c, words in AROUND_NAMES.items() for w in words.split()}


class _Made(dict):
    """What a function makes of each key, made once; it begins anew when there are too many, and keeps nothing of keys above a length."""

    MOST, LONGEST = 50_000, 80

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key if isinstance(key, str) else "".join(map(str, key))) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[key] = value
        return value


def _kind(word: str, words: Words, shouted: bool) -> str:
    """Of one word: initial, or unknown, known small, known with a capital; and how it is written here. In a shouted text capitals tell nothing."""
    if len(word) == 1:
        return "iT" if word.isupper() and not shouted else "il"
    parts = word.lower().replace("’", "'").replace("'", "-").split("-")
    known = "k" if all(p in words.small for p in parts) else "u" if any(p not in words.small and p not in words.capital for p in parts) else "p"
    return known + ("l" if shouted else "A" if word.isupper() else "T" if word[0].isupper() else "l")


def _class(token: str, words: Words) -> str:
    """The class of a word, the mark itself, ``w`` or ``W`` for other words, unknown ones as ``u`` and ``U``, ``9`` for numbers."""
    low = token.lower()
    if low in _CLASS:
        return _CLASS[low]
    if low[0].isdigit():
        return "9"
    if not low[0].isalpha():
        return low
    value = "w" if low in words.small else "u"
    return value.upper() if token[0].isupper() else value


class Token:
    """A word or mark: as written and in small letters, its class, its kind (none for marks and ordinary words written small), whether it is an ordinary word, and one without a class of its own."""

    __slots__ = ("written", "low", "group", "kind", "size", "ordinary", "plain")

    def __init__(self, written: str, words: Words, shouted: bool = False):
        self.written, self.low, self.size = written, written.lower(), len(written)
        self.ordinary = self.low in words.small
        self.plain = self.ordinary and self.low not in _CLASS
        known = (self.low if shouted else written) in words.small
        self.group = _class(self.low if shouted else written, words)
        self.kind = _kind(written, words, shouted) if not known and written[0].isalpha() else ""


#: What is outside of a text.
_OUTSIDE = object.__new__(Token)
_OUTSIDE.written = _OUTSIDE.low = _OUTSIDE.group = "<"
_OUTSIDE.kind, _OUTSIDE.size, _OUTSIDE.ordinary, _OUTSIDE.plain = "", 0, False, False


class _Pieces(_Made):
    """What lies between two blanks: its tokens, and the steps from the end of each to the end of the next, from the blank before on. No token has a blank in it."""

    def __init__(self, words: Words):
        super().__init__(self._read)
        self.tokens = _Made(lambda written: Token(written, words))

    def _read(self, piece: str) -> tuple[tuple[Token, ...], tuple[int, ...]]:
        found = [(m.group(), m.end()) for m in _TOKEN.finditer(piece)]
        ends = [-1] + [end for _, end in found]
        return tuple([self.tokens[w] for w, _ in found]), tuple([end - before for before, end in zip(ends, ends[1:])])


_pieces_of = lru_cache(_Pieces)
_TOKENS, _STEPS = itemgetter(0), itemgetter(1)


class Tokens:
    """The words and marks of a text, with what features ask of them: the class of a word, the mark itself, ``<`` outside."""

    def __init__(self, text: str, words: Words):
        self.text = text
        written = text.split(" ")
        pieces = list(map(_pieces_of(words).__getitem__, written))
        self.all: list[Token] = list(chain.from_iterable(map(_TOKENS, pieces)))
        self.ends = list(accumulate(chain.from_iterable(map(_STEPS, pieces)), initial=-1))
        if self.ends[-1] == len(text):
            del self.ends[0]
        else:
            # Steps know nothing of white space behind the last token of a piece.
            self.ends, at = [], -1
            for piece, (_, steps) in zip(written, pieces):
                self.ends += list(accumulate(steps, initial=at))[1:]
                at += len(piece) + 1
        #: The kinds of all but marks and ordinary words written small.
        self.kinds = {k: token.kind for k, token in enumerate(self.all) if token.kind}
        if len([kind for kind in self.kinds.values() if kind in _CAPITALS]) > NAME_WORDS + 1 and _NO_SMALL.search(text):
            for k in self._shouted():
                self.all[k] = token = Token(self.all[k].written, words, shouted=True)
                self.kinds[k] = token.kind
            self.kinds = {k: kind for k, kind in self.kinds.items() if kind}
        # Found at -1 and -2, and beyond the last.
        self.all += [_OUTSIDE, _OUTSIDE]

    def _shouted(self) -> list[int]:
        """Words in capitals among so many others that capitals tell nothing there."""
        found: list[int] = []
        run: list[int] = []
        for k, token in enumerate(self.all):
            if token.written[0].isalpha():
                if token.kind in _CAPITALS:
                    run.append(k)
                else:
                    if len(run) > NAME_WORDS + 1:
                        found += run
                    run = []
        return found + run if len(run) > NAME_WORDS + 1 else found

    @cached_property
    def low(self) -> list[str]:
        return [token.low for token in self.all[:-2]]

    @cached_property
    def starts(self) -> list[int]:
        return [end - token.size for end, token in zip(self.ends, self.all)]

    def start(self, k: int) -> int:
        return self.ends[k] - self.all[k].size

    def opens(self, k: int) -> bool:
        """Whether a sentence may begin here: after a mark that ends one or an odd one, and after more than one blank."""
        if k == 0:
            return True
        before, end = self.all[k - 1].low, self.ends[k - 1]
        return self.ends[k] - self.all[k].size - end > 1 or "\n" == self.text[end] or not (before[0].isalnum() or before in ",;:'’&-–—(\"“/@#$")


def name_spans(t: Tokens, words: Words) -> list[tuple[int, int, str, int, int]]:
    """(start, end, pattern, first token, last token) of whatever may be a name, by how its words are written.

    Words with a capital, in a row or joined by initials and small joining words; and words in one case throughout of which one at least is no
    ordinary word. A name of two parts may be turned around a comma. Written small, a name must begin where one can be expected: after a
    word that names or calls people, or after a mark or a small word if it also ends at such a place. So must an ordinary word that opens a sentence.
    Of a row of words with capitals, only what opens a sentence or calls people can stand before the name, and only an ordinary word, which may open
    the next sentence, behind it.
    """
    text, found, tokens, ends = t.text, [], t.all, t.ends
    kinds, last = dict(t.kinds), len(ends) - 1
    for k, kind in t.kinds.items():
        if kind == "ul" or kind == "pl":
            # An ordinary word beside one that isn't.
            if tokens[k + 1].ordinary and k + 1 not in kinds:
                kinds[k + 1] = "kl"
            if tokens[k - 1].plain and k - 1 not in kinds:
                kinds[k - 1] = "kl"
    for k, first in kinds.items():
        if first == "kl" and k + 1 not in kinds:
            continue
        if first[0] == "i" and tokens[k + 1].low != ".":
            continue
        case = first[1]
        if case == "l":
            before = tokens[k - 1].group
            if before in _NOT_AFTER:
                continue
            weak = before not in _EXPECT
        else:
            if kinds.get(k - 1, "ll")[1] != "l" and t.start(k) - ends[k - 1] == 1 and not t.opens(k - 1) and tokens[k - 1].group not in _EXPECT:
                continue
            weak = first == "kT" and t.opens(k)
        pattern, j, n, comma, joined = "", k, 0, False, 0
        while True:
            kind = kinds.get(j)
            pattern += kind
            n += 1
            end = ends[j]
            if kind[0] == "i":
                if tokens[j + 1].low != ".":
                    break
                j += 1
                end = ends[j]
            # An initial alone is no name, nor is an ordinary word written small or one in capitals among others.
            if (n > 1 or (kind[0] != "i" and kind != "kl")) and not (case == "l" and not ("u" in pattern or "p" in pattern or "i" in pattern)) and not (weak and (n == 1 or case == "l") and tokens[j + 1].group in _GOES_ON) and (
                case == "l" or j == last or kinds.get(j + 1, "kl")[1] == "l" or kinds[j + 1][0] == "k" or t.start(j + 1) - end != 1
            ):
                found.append((t.start(k), end, pattern, k, j))
            if n == NAME_WORDS or comma:
                break
            j += 1
            if n == 1 and kind[0] != "i" and j <= last and tokens[j].low == ",":
                pattern, comma = pattern + ",", True
                j += 1
            while j <= last and tokens[j].low in PARTICLES and joined < JOINING and not comma and case != "A" and kinds.get(j, "kl")[1] == "l":
                pattern, joined = pattern + "+", joined + 1
                j += 1
            if j not in kinds or text[ends[j - 1] : t.start(j)] not in (" ", "\u00a0"):
                break
            # All words of a name are written alike; an initial may be a capital anywhere.
            if kinds[j][1] != case and kinds[j][0] != "i" and first[0] != "i":
                break
            if first[0] == "i" and n == 1:
                case = kinds[j][1]
            elif first[0] == "i" and kinds[j][1] != case:
                break
            pattern += " "
    return found


@lru_cache(100_000)
def _shape_of(pattern: str) -> str:
    return "".join(c for c in pattern if c in "TlA ,")


def _name_keys(t: Tokens, pattern: str, k: int, j: int) -> tuple:
    """What the features of a name ask, for each of ``_NAME_PARTS``."""
    tokens, opens = t.all, "^" if t.opens(k) else ""
    first, before, behind, after2 = tokens[k], tokens[k - 1], tokens[j + 1], tokens[j + 2].group
    group, after = before.group, behind.group
    glued = "'" if behind.low in ("'", "’") else behind.low if behind is not _OUTSIDE and t.start(j + 1) == t.ends[j] else ""
    return (
        (pattern, opens, group, tokens[k - 2].group), (pattern, opens, after, after2), (opens, group, after, glued, after2 if glued else "", len(_shape_of(pattern))), before.low, behind.low,
        (tokens[k - 2].low, group), (first.group, tokens[j].group if j > k else ""), (first.low if pattern[0] == "k" else "", opens),
    )


#: The features of a name, those together that ask the same things.
_NAME_PARTS: tuple[Callable[..., tuple[str, ...]], ...] = (
    lambda key: (f"n|{key[0]}", f"n|{key[0]}{key[1]}", f"n|{_shape_of(key[0])}|{key[2]}", f"n|{key[0][:2]}|{key[2]}", f"n|{key[3]} {key[2]}{key[1]}"),
    lambda key: (f"n|{_shape_of(key[0])}{key[1]}|{key[2]}", f"n|{key[0][-2:]}|{key[2]}", f"n|{key[2]} {key[3]}"),
    lambda key: (f"n|{key[1]} {key[2]}{key[0]}", f"n|{key[3]}{key[4]}", f"n|{key[0]}{key[1]}{key[3]}{key[5]}"),
    lambda word: (f"n|-1 {word}",),
    lambda word: (f"n|+1 {word}",),
    lambda key: (f"n|-2 {key[0]} {key[1]}",),
    lambda key: (f"n|of {key[0]} {key[1]}",),
    lambda key: (f"n|word {key[0]}{key[1]}",) if key[0] else (),
)


def _name_features(t: Tokens, pattern: str, k: int, j: int) -> list[str]:
    return [f for part, key in zip(_NAME_PARTS, _name_keys(t, pattern, k, j)) for f in part(key)]


class Weights(dict):
    """The weights of features, and their sums over the parts of a name's features, each made once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(weights)
        self.parts = [_Made(lambda key, part=part: sum(self.get(f, 0.0) for f in part(key))) for part in _NAME_PARTS]

    def __reduce__(self):
        return Weights, (dict(self),)

    def of_name(self, t: Tokens, pattern: str, k: int, j: int) -> float:
        return sum([sums[key] for sums, key in zip(self.parts, _name_keys(t, pattern, k, j))])


def proposals(text: str, words: Words) -> list[tuple[int, int, str, str]]:
    """(start, end, type, form) of all candidate segments of a text."""
    return [s[:4] for s in candidates(Tokens(text, words), words)]


def _form_spans(text: str) -> set[tuple[int, int, str, str]]:
    found = {(m.start(1), m.end(1), kind, name) for kind, name, form in FORMS for m in form.finditer(text) if m.end(1) > m.start(1)}
    return {x for x in found if x[3] != "mixed" or sum(c.isdigit() for c in text[x[0] : x[1]]) >= 7}


def candidates(t: Tokens, words: Words) -> list[tuple[int, int, str, str, int, int]]:
    """The candidate segments of a text in order, with the tokens of names (-1 for other types)."""
    parts = stretches(t.text)
    found = sorted({(a + s, b + s, kind, form, -1, -1) for s, e in parts for a, b, kind, form in _form_spans(t.text[s:e])}) if parts else []
    return found + [(s, e, "person_name", pattern, k, j) for s, e, pattern, k, j in name_spans(t, words)]


def _shape(token: str) -> str:
    return "9" if token[0].isdigit() else "@" if not token[0].isalnum() else "l"


def features(t: Tokens, spans: list[tuple]) -> list[list[str]]:
    """The features of each candidate: of the whole span, and of the words before and after it."""
    return [_name_features(t, s[3], s[4], s[5]) if s[4] >= 0 else _form_features(t, *s[:4]) for s in spans]


def _form_features(t: Tokens, start: int, end: int, kind: str, form: str) -> list[str]:
    text, k, j = t.text, bisect_right(t.starts, start) - 1, bisect_left(t.starts, end)
    before = t.low[max(0, k - 3) : k][::-1] + ["<"] * 3
    after = t.low[j : j + 2] + [">"] * 2
    touching = text[end : end + 1] if end < len(text) and not text[end].isspace() else ""
    glued = text[start - 1 : start] if start and not text[start - 1].isspace() else ""
    f = f"{kind}|{form}"
    return [
        f, f"{f}|{min(j - k, 8)}", f"{kind}|touch {touching}", f"{kind}|glue {glued}",
        f"{kind}|-1 {before[0]}", f"{kind}|-2 {before[1]}", f"{kind}|-3 {before[2]}", f"{kind}|+1 {after[0]}", f"{kind}|{touching}+2 {after[1]}",
        f"{kind}|shape {_shape(after[0])}", f"{f}|{touching}{after[0] if touching else ''}",
    ]


def _lattice(spans: list[tuple]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """All ends and starts in order, and the segments between them, by end: (start, end, number)."""
    places = sorted({p for s in spans for p in s[:2]})
    at = {p: k for k, p in enumerate(places)}
    return places, sorted(((at[s[0]], at[s[1]], n) for n, s in enumerate(spans)), key=lambda x: x[1])


def decode(spans: list[tuple], scores: list[float]) -> list[int]:
    """Numbers of the segments of the best set without overlaps; text outside of segments weighs 0."""
    places, arcs = _lattice(spans)
    best: list[float] = [0.0] * len(places)
    back: list[tuple[int, int] | None] = [None] * len(places)
    by_end: dict[int, list[tuple[int, int]]] = {}
    for s, e, n in arcs:
        by_end.setdefault(e, []).append((s, n))
    for e in range(len(places)):
        if e:
            best[e] = best[e - 1]
        for s, n in by_end.get(e, ()):
            if best[s] + scores[n] > best[e]:
                best[e], back[e] = best[s] + scores[n], (s, n)
    chosen, e = [], len(places) - 1
    while e >= 0:
        if back[e] is not None and (e == 0 or best[e] > best[e - 1]):
            s, n = back[e]
            chosen.append(n)
            e = s
        else:
            e -= 1
    return chosen[::-1]


def _log_add(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a + math.log1p(math.exp(b - a))


def marginals(spans: list[tuple], scores: list[float]) -> list[float]:
    """The probability of each segment, by forward and backward sums."""
    places, arcs = _lattice(spans)
    ahead, behind = [0.0] * len(places), [0.0] * len(places)
    ends: dict[int, list[tuple[int, int]]] = {}
    begins: dict[int, list[tuple[int, int]]] = {}
    for s, e, n in arcs:
        ends.setdefault(e, []).append((s, n))
        begins.setdefault(s, []).append((e, n))
    for e in range(1, len(places)):
        ahead[e] = ahead[e - 1]
        for s, n in ends.get(e, ()):
            ahead[e] = _log_add(ahead[e], ahead[s] + scores[n])
    for s in range(len(places) - 2, -1, -1):
        behind[s] = behind[s + 1]
        for e, n in begins.get(s, ()):
            behind[s] = _log_add(behind[s], behind[e] + scores[n])
    total = ahead[-1] if places else 0.0
    return [math.exp(min(0.0, ahead[at_s] + scores[n] + behind[at_e] - total)) for at_s, at_e, n in sorted(arcs, key=lambda x: x[2])]


# ---- training sentences -------------------------------------------------------------------------

# Templates, one to each bar: {n} is a name and {email} and so on a case; other slots are made up by ``_fill``. A slot with a capital starts with one.
_NAMES = """{n} {did} us|{n} {did} the {word} and {did}|our {role} {n} {did} it|Our {role}, {n}, {did} the {word}|the {role} {n} {did} the {word}|A {role} named {n} {did} us|a {role} called {n} {did}
My {kin} {n} {did} the {word}|my {kin} {n} and I {did} the {word}|His {kin} {n} is {word}|Her {kin}, {n}, {did} a {word}|I came with {n} and {n}|Came here with my {kin} {n}|went with {n} for {word}
We asked {n} about the {word}|I told {n} that the {word} was {word}|They sent {n} with the {word}|Met {n} at the {word}|We met {n} {did_now} the {word}|I saw {n} at the {word}|Spoke to {n} about it|I emailed {n} twice
{n} was {word} and {word}|{n} is a {word} {role}|{n} is the {word} {role} in town|{n} was so {word}|{n} really {did} the {word}|{n} always {did} us|{n} even {did} the {word}
Big thanks to {n}|Thank you {n} for the {word}|Thanks {n}|Thanks, {n}, for the {word}|thanks to {n} and {n} for a {word} {word}|Hats off to {n}|Credit to {n} and {n}|Cheers {n}!|Bravo {n}!|Props to {n}!|Kudos {n}!|Congrats, {n}!|Bless you, {n}!|Well played, {n}!
Hi {n}, the {word} is {word}|Dear {n}, we {did} it|Regards, {n}|Sincerely, {n}|Yours, {n}|Love, {n}|- {n}|~ {n}|Signed, {n}|signed {n}, a {word} guest|P.S. {n} rocks
Say hello to {n} when you go|If {n} is there, sit with the {word}|Request {n} if you can|Ask for {n}|ask for {n}, you will not be {word}|Look for {n} at the {word}|Find {n}, the {role}|Please tell {n} we {did} it|with {n} as our {role}|thanks to our {role} {n}|{n}, our {role}, {did} us
Contact: {n}, {phone}|contact {n} at {email}|{n}, {phone}|{n}; {phone}; {email}|{n} ({phone})|{n}, {email}, {phone}|Name: {n}|Table under {n} for {two}|under the name {n}|The account of {n}, {street_address}|the receipt says {n}, {id_number}|Card of {n} ({id_number})|Our details: {n}, {id_number}, {phone}|they have it all: {n}, {phone}|sold to {n}, {street_address}|delivered to {n} at {street_address}|owned by {n} and {n}|run by {n}|cooked by {n}|baked by {n} and the {kin}
We sat next to {n} all night|told by {n} that it was {word}|as {n} said, {word}|said {n}|according to {n}, the {word} is {word}|{n}'s {word} was {word}|{n}’s {kin} {did} the {word}|waiting for {n} to {did_now}|We waited on {n} for the {word}|without {n} it would be {word}|the {role} (I think {n}) {did} us|a portrait of {n} above the {word}|{picture} of {n} everywhere|a {picture} of {n}|the {picture} of {n} by the {word}|made out to {n}|billed to {n}, {street_address}|it belongs to {n}|issued to {n}|addressed to {n}, {street_address}|assigned to {n}
{title} {n} {did} us|{Title} {n} {did} the {word}|Chef {n} {did} the {word}|chef {n} knows {word}|{title}. {n} was {word}|{n} from the {word} {did} us|{n} at the {word} {did} it|{n} here: {word} {word}|{n} again, this {word} {word}: {email}|It was {n} who {did} us|Is {n} still there?|{Opener} {n} {did} {link} the {word}|{Opener} {n} {did} {possessive} {word}|{Opener} {n} {did} {word} {word}|{did} it {link} {n}|we {did} {link} {n} {day}|the {word} {link} {n} {did} {word}|{did} {link} {n} {link} {n}|{word} {n} {does} {word} the {word}|whether {n} {does} {word}|Yours {word}, {n}|{Word} regards, {n}|{Opener} {n} {did} {word}|{Opener} {n} {does} {word}|{Opener} {n} {did} {link} the {word}|{did} that {n} {did} it|{did} {link} {n} {word} {word}|{did} {link} {n} last {word}|himself as {n}|herself {n}|{word} but {n} {did} it|{did} {n} along|{word} to {n} {link} the {word}|{n} {did} {possessive} {word} {word}|I {did} {n}|{possessive} {kin} {did} {n}|we {did} {n}, who {did} {word}|{did} by {n}|{did} by {n} and {did}|give {n} the {word}|if I {did}, {n} {did} {word}|and {n} {did} {word} {word}|{n} {does} the {word}|{n} {does} so {word}|{n} {did} over {link} the {word}|at night {n} {did} {word}|{Role}: {n}|{Role} {n} {did} {possessive} {word}|{kin} and {n} {did} {food}|{word} {n} {did} {word}|even {n} {did}|{word} with {n} about {word}|see {n}, {word} the {food}|Was it {n}? The {word} was {word}|They said {n} would {did_now} it, no {word} since; call me at {phone}"""
_OTHERS = """Write to {email} for the {word}|my address is {email} if you find the {word}|send it to {email} or {street_address}|email me: {email}|{email} is where to send it|photos at {email}|questions? {email}, or {phone}
Call {phone} before the {word}|call or text {phone}, please|Her number is {phone}|They rang {phone} four times|my phone: {phone}|{phone} is the line to try|text {phone} and {word}|ring me on {phone}|You can fax {phone}
My licence {id_number} was on the {word}|passport {id_number} is lost|Permit {id_number} is on the wall|permit no. {id_number} in the {word}|They kept my card, {id_number}, all night|tax number {id_number}|ID {id_number}, please {word}|social security {id_number}|her visa {id_number} was {word}|number {id_number} on the badge|copied {id_number} from my card|noted {id_number} for the age check
We live at {street_address} near the {word}|mail it to {street_address} and call {phone}|It was left at {street_address} by the {word}|our home is {street_address}|{street_address} is where we stay|send the {word} to {street_address}|moved to {street_address} in {Month}|they shipped it to {street_address}"""
_NOTHING = """we loved it {place} {Place}|{place} {Place} the {word} is {word}|{place} {Place} {spot}|{link} {Spot} {Place}|the {word} over {Spot} {Place} {does} {word}|near {Spot} {Place}|{link} {Place} {Spot} {does} a {word}|it {did} {Spot} {Place} to me|in {Spot} {Place} at night|{link} {Place} {food} {does} {word}|{possessive} {Place} {food} {link} {Place} {food}|{did} {Place} and {Place}|the {Place} {spot} is {word}|{Place} {Spot} was {word}|{Place}'s {Spot} has a {word}|{Place}’s is better|Better than {Place}'s {Spot}|at {Place}'s on the corner|We went to {Place} {Spot}|from {Place} to {Place}|drove in from {Place}|drove {place} {Place} {Place}|a trip to {Place}|the {Place} {food}|a {Place} {food} and a {food}|{Place} {food} with {food}|all the way from {Place}, {Place}|downtown {Place}|outside {Place} on {Day}|the {Place} {word} during {Day}|{Place} style {food}|my {Place} {food}
{Nation} {food} {link} {Nation} {food}|the {Nation} {food}|{possessive} {Nation} {kin}|{link} {Nation} {word} {does} {word}|{did} it on {Place}|{did} {link} {Place} and {did}|{word} on {Place}|by {Place} {link} {day}|on {Day}|last {Day} the {word} was {word}|in {Month}|every {Day} night|We came on {Day}, {Month} {two}|for {Day} {word}|It was {Day} and the {word} {did}|their {Place} menu|our {Place} trip|an {Place} lager|a glass of {Place} with {food}|two {Place} beers|the band played {Place} {Place}|read {Place} {Place} on the way|I use {Place} for this|a {Place} card
the {food} was {word}|{Food} and {food} were {word}|a {word} {food}|ordered the {food} and the {word} {food}|{food} with {food}|try the {word} {food}|{Food} was {word}|my {food} came {word}|the {food} {food} {did}|some {food}, {food} and {food}|{food} in {food}|with {food} on the side|between {food} and the {food} with {food}|pair {food} with {food}|paired it with {food}|{Word} {food} is {word}|an {word} {food} {word}|for once the {word} {did}, and {food} made it {word}|We split {food}|{did} {food} before the {word}|I {did} some {food}|the {food} over {food}, {word}|everything about the {food} felt {word}|get the {food} with {food}; the {word} is {word}|{word} {food}, please|The {Food} {Word} and the {Word} {Food}|the {Word} {Word} {food}|{Food} {Food} is on the menu|HAPPY HOUR {food}
so {typo} when the {word} {did}|{word}: {food}, {typo} and {typo}|{did} {food} {link} {food} {link} the {word}|the {food} {link} {food} {link} {word} {food}|{food} {link} {food}, {word}|{word} {link} {typo} {link} {typo}|a {food} {link} {word} {food}; {word}|{did} the {food} {food} {link} {food} {link} {did} it|{Food} {link} {food} {did}|{possessive} {food} {food} {link} {food}|{number} plates of {food} {link} {food}|{determiner} {word} {food}|{possessive} {kin} {did} {food} {link} {food}|the {role} {did} {food} {typo}|{kin} {food} {link} {food}|the {spot} {did} {food}: {typo}
the {word} {typo} was {word}|{typo} {word} and {typo}|a {typo} {word}|I {did} the {typo}|it was {typo}|{Typo} was {word}|the {WORD} {word}|it is NOT {word}|THE {WORD} {WORD} EVER|{Word} {WORD}, {word}|so {WORD}
{Opener} {word} the {word} {word}|{Opener} {word} {word} {word} {word}|{Opener}, the {word} was {word}|{Opener} {did} {word}|{Opener} {does} a {word} {food}|There is a {typo} {word} in the {food}|There was no {food}|It {does} {word}|{Opener} {does} {word}|{Opener} the {word}|{Opener} our {role} {did} us|{Opener} my {kin} and I {did} the {word}|The {role} {did} the {word}|The {role} was {word}|our {role} {did} us|my {kin} {did} the {food}|A {word} {kin} {did} it|A {kin} from {word} called the {food} {word}|{Word} is {word}|{Word} {word} is {word}, {word} the {word}|{Word}, {word}, {word}|{Word} and {word} for {word}|- {Word} {word}|- {Word}|{Opener}!|{Word} {word}!|Thanks for the {word}|Thank you for {word} {food}|Cheers to the {word}|Kudos to the {role}|Credit to the {word}|ask for the {food}|Ask for {word} {food}|Say {word} to the {word}|Dear {role}, {word} the {word}|Hi there, {word}|Love this {spot}|Love the {food}|{Word} was our {word}|He said {word} and {did}|I think {Word} is a {word}|at the {spot}|the {word} {spot} by the {spot}
order #{number}-{two} took {two} minutes|Order {number}-{two} was late|batch {three}-{two} of {food}|Lot {three}-{two} was {word}|ticket {six}, table {two}|table {two}, ticket number {six}|booking {code} failed|code {code} did nothing|reservation {six} was lost|confirmation {code} for {one}|invoice {six}-{two}|It cost ${number} with {two}% on top|${two}.{two} for the {food}|open from {one}:{two} to {one}:{two}|hours are {one}-{one}:{two}|closed {one}/{two}/20{two}|since 20{two} or 20{two}|from 19{two} to 20{two}|about {number} calories|rated {one}.{one} by {number} people|{two} of the {food} for {two}|{number} people at the {word}|pay {two} dollars at the {word}|two for ${one} at the {word}|{one} stars out of {one}|gate {two}, seat {two}|item {six} is {word}|loyalty points: {number}"""
_OPENERS = "We I They The It This My Our You If When After Before Then But And So Not No Never Always Honestly Overall Sadly Luckily Maybe Just Great Good Best Nice Wow Yes Well Also Still Only Even Once Next Everyone Nobody Somebody Whoever Compared With For From At In On Try Skip Go Get Do Don't Loved Came Had Went Stopped Tip Between Half Because While Where What Why How There Here Delivery Service Parking Price".split()
_DID = "was took brought helped greeted seated kept poured served made gave told said smiled explained offered remembered came handled checked recommended suggested refilled ran laughed wrote called ordered wanted liked shared skipped tried devoured finished packed carried dropped forgot rushed cooked baked left picked loved hated sampled split photographed praised fixed".split()


class _Maker:
    """Made-up sentences and their cases, from a random source and the known words."""

    def __init__(self, r: random.Random, words: Words):
        self.r = r
        self.small = sorted(w for w in words.small if 3 <= len(w) <= 9)
        self.capital = sorted(w for w in words.capital if 3 <= len(w) <= 10)
        self.groups = [[[t.strip() for t in line.split("|")] for line in block.splitlines()] for block in (_NAMES, _OTHERS, _NOTHING)]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def coined(self) -> str:
        """A word that sounds like one: syllables of a consonant, a vowel and at times another consonant."""
        r = self.r
        return "".join(r.choice("b br c ch d dr f fl g gr h j k kl l m n p qu r s sh st t th tr v w y z".split()) + r.choice("a e i o u a e i o ai ea ee ie oa ou".split()) + r.choice(["", "", *"lmnrstkxd", "nd", "rt", "ck"]) for _ in range(r.choice([1, 2, 2, 3])))

    def part(self) -> str:
        """One word of a name of anything: coined, one that is known with a capital, or an ordinary one."""
        how = self.r.random()
        return (self.coined() if how < 0.5 else self.r.choice(self.capital) if how < 0.85 else self.r.choice(self.small)).capitalize()

    def surname(self) -> str:
        how, a = self.r.random(), self.part()
        if how < 0.08:
            return f"{a}-{self.part()}"
        if how < 0.12:
            return self.r.choice(["O'", "O’", "D'"]) + a
        if how > 0.95:
            return self.r.choice(f"{AROUND_NAMES['role']} {AROUND_NAMES['spot']}".split()).capitalize()
        if how < 0.18:
            return " ".join([*self.r.choice(["de", "de la", "van", "van der", "von", "del", "bin", "al", "da"]).split(), a])
        return a

    def name(self) -> str:
        r, a = self.r, self.part()
        return r.choices([a, f"{a} {self.surname()}", f"{a} {r.choice('ABCDEFGHJKLMNPRSTVWZ')}. {self.surname()}", f"{self.surname().split()[-1]}, {a}", f"{a[0]}. {self.surname()}", f"{a} {self.part()[0]}.", f"{a} {self.part()} {self.surname()}"], [30, 40, 8, 7, 8, 4, 3])[0]

    def typo(self) -> str:
        w = self.r.choice(self.small)
        k = self.r.randrange(len(w))
        return self.r.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + self.r.choice("aeiourstn") + w[k + 1 :]])

    def case(self, kind: str) -> str:
        r, digits, coined = self.r, self.digits, self.coined
        if kind == "email":
            local = r.choice([coined(), f"{coined()}.{coined()}", coined() + digits(2), f"{coined()}_{coined()}", f"{coined()}+{coined()}"])
            place = r.choice([coined(), f"{coined()}.{coined()}"]) + "." + r.choice(["example", "test", "invalid", "com", "org"])
            at, dot = r.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", "."), (" (at) ", " (dot) ")])
            return local + at + place.replace(".", dot)
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+44 20 {c} {digits(4)}", f"020 {c} {digits(4)}", f"{a}{b}{c}"])
        if kind == "id_number":
            return r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9), f"{digits(2)}-{digits(7)}", r.choice("ABCDXYZ") + f"{digits(3)}-{digits(4)}-{digits(4)}", r.choice("ABCDXYZ") + r.choice("KLMNPV") + digits(7)])
        road = f"{r.randint(1, 9999)}{r.choice(['', '', '', 'A', 'B'])} {r.choice(['', '', '', 'Old ', 'New ', 'N ', 'West '])}{self.part()}{r.choice(['', '', ' ' + self.part()])} {r.choice(STREETS[:18]).capitalize()}"
        unit = f"{r.choice(['Unit', 'Apt', 'Suite'])} {r.randint(1, 40)}"
        return r.choice([road, road, f"{unit}, {road}", f"{road}, {unit}", f"{road} #{r.randint(1, 99)}"])

    def fill(self, slot: str) -> str:
        r, low = self.r, slot.lower()
        sizes = {"one": 1, "two": 2, "three": 3, "number": 4, "five": 5, "six": 6}
        if low in sizes:
            return str(r.randint(10 ** (sizes[low] - 1), 10 ** sizes[low] - 1))
        if low == "code":
            return r.choice("TRQZ") + r.choice("XYZ") + str(r.randint(1000, 9999))
        if low == "opener":
            w = r.choice(_OPENERS)
            k = r.randrange(1, len(w)) if len(w) > 2 and r.random() < 0.1 else 0
            return w[:k] + w[k - 1 : k] + w[k:] if r.random() < 0.5 or not k else w[:k] + w[k + 1 :]
        if low == "place":
            return self.part() + (f" {self.part()}" if r.random() < 0.2 else "")
        if low in ("did", "did_now"):
            return r.choice(_DID) if r.random() < 0.6 else r.choice(self.small) if r.random() < 0.5 else self.typo()
        if low == "food":
            # One to three words, known or not.
            w = " ".join(r.choice([self.coined, self.coined, self.typo, lambda: r.choice(self.small), lambda: r.choice(self.small)])() for _ in range(r.choice([1, 2, 2, 3])))
        elif low == "word":
            w = r.choice(self.small)
        elif low == "typo":
            w = self.typo()
        else:
            w = r.choice(AROUND_NAMES[{"month": "day"}.get(low, low)].split())
        return w.upper() if slot.isupper() else w.capitalize() if slot[0].isupper() else w

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A made-up stretch of text and its cases."""
        r, out, cases = self.r, "", []
        for _ in range(r.choice([1, 2, 3])):
            lines = self.groups[r.choices([0, 1, 2], [3, 1.5, 12])[0]]
            template = r.choice(r.choice(lines))
            begun = len(out)
            for part in re.split(r"(\{\w+\})", template):
                if part.startswith("{"):
                    slot = part[1:-1]
                    kind = "person_name" if slot == "n" else slot
                    part = self.name() if slot == "n" else self.case(slot) if slot in TYPES else self.fill(slot)
                    if kind in TYPES:
                        # A name at times all small or in capitals, whatever is around it.
                        part = r.choices([part, part.lower(), part.upper()], [30, 1, 1])[0] if slot in ("n", "street_address") else part
                        cases.append((len(out), len(out) + len(part), kind))
                out += part
            if out[begun : begun + 1].islower() and r.random() < 0.5 and not any(c[0] == begun for c in cases):
                out = out[:begun] + out[begun].upper() + out[begun + 1 :]
            out += r.choices([". ", "! ", "? ", " ... ", ", ", ".\n", "\n\n", " - ", ".  ", " ", "  ", " * "], [10, 2, 1, 1, 1, 1, 1, 1, 1, 3, 2, 1])[0] if not out.endswith(("!", "?")) else " "
        how = r.random()
        return (out.lower() if how < 0.1 else out.upper() if how < 0.16 else out), cases


@lru_cache
def train(vocabulary: str = VOCABULARY, sentences: int = TRAINING, passes: int = PASSES, seed: int = SEED) -> Weights:
    """Feature weights by adaptive gradient steps on the conditional likelihood."""
    r, words = random.Random(seed), known_words(vocabulary)
    maker = _Maker(r, words)
    data = []
    for _ in range(sentences):
        text, cases = maker.sentence()
        if len(text) != len(text.lower()):
            continue
        t = Tokens(text, words)
        if spans := candidates(t, words):
            gold = set(cases)
            data.append((spans, features(t, spans), [s[:3] in gold for s in spans]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(passes):
        r.shuffle(data)
        for spans, feats, gold in data:
            scores = [sum(weights.get(f, 0.0) for f in fs) for fs in feats]
            seen: set[tuple[int, int, str]] = set()
            for p, fs, y, s in zip(marginals(spans, scores), feats, gold, spans):
                # A case that two forms propose is one.
                target = float(y and s[:3] not in seen)
                seen.add(s[:3])
                g = target - p
                if abs(g) < 0.02:
                    continue
                for f in fs:
                    squares[f] = squares.get(f, 0.3) + g * g
                    weights[f] = weights.get(f, 0.0) * 0.9995 + 0.25 * g / math.sqrt(squares[f])
    return Weights({f: w for f, w in weights.items() if abs(w) > 0.01})


# ---- decoding ---------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text in which forms are tried: around each thing that can begin a segment of one, merged."""
    spots = []
    digits = bool(_DIGIT.search(text))
    for m in _NUMBER.finditer(text) if digits else ():
        first, end = m.span()
        if road := _ROAD_AFTER.match(text, end - (text[end - 1] == " ")):
            # A unit may stand before it.
            spots.append((len(text[:first].rstrip()), road.end()))
        elif end - first >= _LEAST_NUMBER:
            spots.append((first, end))
    if digits:
        spots += [m.span() for m in _MIXED.finditer(text) if m.end() - m.start() >= _LEAST_MIXED and sum(c.isdigit() for c in m.group()) >= _LEAST_MIXED]
    for m in _AT_WORD.finditer(text) if _POINT.search(text) or "dot" in text.lower() else ():
        if place := _PLACE_AFTER.match(text, m.end()):
            spots.append((len(text[: m.start()].rstrip(" \t\n[(")), place.end()))
    merged: list[list[int]] = []
    for s, e in sorted(spots):
        s, e = max(0, s - AROUND), min(len(text), e + AROUND)
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def find(text: str, weights: Weights, words: Words) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information in a text, in order."""
    t = Tokens(text, words)
    spans, scores = [], []
    for span in candidates(t, words):
        score = weights.of_name(t, span[3], span[4], span[5]) if span[4] >= 0 else sum(map(weights.get, _form_features(t, *span[:4]), repeat(0.0)))
        if span[4] >= 0:
            score -= SMALL_PRIOR if "l" in span[3] else ORDINARY_PRIOR if span[3] == "kT" else 0
        if score > 0:  # what lowers the sum is in no best set
            spans.append(span)
            scores.append(score)
    return [spans[n][:3] for n in decode(spans, scores)] if spans else []


def _prepared(df: DataFrame, vocabulary: str):
    """Weights and words, sent to the tasks once (some 30,000 words and weights, whatever the data)."""
    return df.sparkSession.sparkContext.broadcast((train(vocabulary), known_words(vocabulary)))


def find_pii(df: DataFrame, record_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """record id, pii_type, pii_text, once each.

    Null ids, null and empty texts have none. Equal strings in one record are one row. The whole of each text is
    read. Other columns are not.
    """
    model = _prepared(df, vocabulary)
    kind = df.schema[record_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = model.value
        for batch in batches:
            rows = [(i, k, t[s:e]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and t for s, e, k in find(t, weights, words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[record_id, "pii_type", "pii_text"]
            )

    return df.select(record_id, text).mapInArrow(run, f"`{record_id}` {kind}, pii_type string, pii_text string").distinct()


def mask_pii(df: DataFrame, record_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """record id, masked: each text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[STREET_ADDRESS]`` and
    ``[PERSON_NAME]`` in place of its cases, all else as it was; null stays null. One row per record id."""
    model = _prepared(df, vocabulary)
    kind = df.schema[record_id].dataType.simpleString()

    def masked(t: str | None, weights: Weights, words: Words) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, k in find(t, weights, words):
            out += [t[at:s], f"[{k.upper()}]"]
            at = e
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = model.value
        for batch in batches:
            texts = [masked(t, weights, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[record_id, "masked"])

    out = df.where(F.col(record_id).isNotNull()).select(record_id, text).mapInArrow(run, f"`{record_id}` {kind}, masked string")
    return out.dropDuplicates([record_id])
