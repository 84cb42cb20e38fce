"""Link the variants of names typed by people (problem 2).

Method: names are folded (widths, look-alikes, case, accents) and become TF-IDF weighted vectors of
character n-grams. An exact similarity join finds all pairs above a cosine threshold that the comparison accepts:
names meet at keys that such a pair must share (surname less a letter, words of organisations), as grams are shared by
ever more names of a growing table; then the cosine is taken from the whole vectors. Pairs are compared part
by part (surname, given names, initials, nicknames; words, abbreviations and acronyms of organisations), and average-linkage clustering over each component of linked names groups the variants. ``top_n`` keeps
the n most similar partners of each name only, as a report; by default all partners are kept.

Scale: everything after the first distinct works on different names, not on rows; keys that many names have are
split by given names; all pairs of a component are compared and clustered, those of one with more than FULL_COMPARISON names in
blocks and rounds over the executors, so the result doesn't depend on its size and no task holds a large component.

Defined results: null and blank names link to nothing; a name that only has initials or one letter
links to nothing; values with equal folded forms are variants of each other.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.glyphs import form
from folioforge.operators.graph import connected_components
from folioforge.session import materialize

#: Titles, particles, words of organisations, common English short forms of given names.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd", "md", "msc", "bsc", "sir", "jr", "sr", "ii", "iii"}
PARTICLES = {"de", "di", "da", "du", "del", "der", "den", "van", "von", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "dos", "das"}
ORG_WORDS = ("university", "institute", "society", "association", "centre", "center", "laboratory", "department", "foundation", "council", "consortium", "group",
             "committee", "agency", "ministry", "college", "school", "academy", "organization", "organisation", "collaboration", "network", "commission",
             "research", "national", "international", "office", "bureau", "hospital", "museum", "library", "federation", "union", "trust", "board", "service", "survey")
SHORT = {"abby": "abigail", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ant": "anthony", "bart": "bartholomew", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles",
         "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
         "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "frank": "francis", "fran": "frances", "fred": "frederick", "freddie": "frederick", "fritz": "friedrich",
         "greg": "gregory", "harry": "henry", "hank": "henry", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "jo": "josephine", "josie": "josephine",
         "jack": "john", "johnny": "john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "len": "leonard", "lenny": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
         "peg": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "nat": "natalia", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "phil": "philip", "pip": "philip",
         "becky": "rebecca", "bec": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "susie": "susan",
         "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "liam": "william", "willy": "wilhelm", "willi": "wilhelm", "misha": "mikhail", "katya": "ekaterina", "katia": "ekaterina", "hans": "johannes", "beppe": "giuseppe", "paco": "francisco", "pancho": "francisco", "lupe": "guadalupe", "zosia": "zofia", "isa": "isabella", "bella": "isabella", "dima": "dmitri", "mitya": "dmitri", "natasha": "natalia", "tasha": "natalia", "gosia": "malgorzata", "val": "valentina", "tina": "valentina",  "theo": "theodora", "dora": "theodora", "alex": "alexander", "sandy": "alexander", "larry": "lawrence", "ray": "raymond", "ron": "ronald", "don": "donald", "ken": "kenneth", "jeff": "jeffrey", "gabe": "gabriel", "gus": "augustus", "nate": "nathaniel", "walt": "walter", "vince": "vincent", "zach": "zachary"}
GRAM = 5
#: Least cosine of a candidate pair; least average similarity of two clusters that are merged.
COSINE, LINK = 0.35, 0.5
#: Most bits in which the signatures of two names with a similarity differ.
SLIP_BITS, MASK = 6, (1 << 63) - 1
#: Components of up to this many names are compared and clustered in one task, larger ones in blocks of BLOCK names and in rounds over all.
FULL_COMPARISON, BLOCK = 150, 500
#: A key that more than about HOT names have is split by a second one; names with it are counted in a SAMPLE-th of all.
HOT, SAMPLE = 200, 8
#: Different words of organisations that are compared at a time for abbreviations.
WORD_BLOCK = 2000
_STOP = {"of", "and", "the", "for", "in"}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?", re.UNICODE)
_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "’": "'", "‘": "'"})


@lru_cache(maxsize=200_000)
def fold(name: str) -> str:
    """Look-alikes, widths, case, accents and spacing removed; commas, points and hyphens stay."""
    def spaced(x: str) -> str:
        return re.sub(r"\s*,\s*", ", ", " ".join(x.replace("&", " and ").split())).strip()

    caps = spaced(form(name) or "")
    bare = "".join(c for c in unicodedata.normalize("NFD", caps) if not unicodedata.combining(c))
    # initials written together ("Smith JB") or an acronym are marked while their case is known
    words = bare.split(" ") if bare.isupper() else [_mark(w) for w in bare.split(" ")]
    return " ".join(words).lower().translate(_FOLD)


def _mark(word: str) -> str:
    bare = word.strip(".,()")
    return "+" + bare + ("," if word.endswith(",") else "") if 2 <= len(bare) <= 6 and bare.isalpha() and bare.isupper() else word


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with swaps of neighbours, at most ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) > 2 * most + 2:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


@lru_cache(maxsize=200_000)
def parse(key: str) -> tuple:
    """("org", words, acronyms) or ("person", readings), a reading being (surname, given names)."""
    plain = key.replace("(", " ").replace(")", " ")
    words = [w for w in re.findall(r"\+?[^\W_]+(?:['-][^\W_]+)*\.?", plain)]
    bare = [w.strip(".") for w in words]
    if any(w in ORG_WORDS for w in bare) or " of " in plain or sum(w.endswith(".") and len(w) > 3 and w.strip(".") not in TITLES for w in words) >= 1 and len(words) > 2 or "and" in bare:
        return "org", tuple(w for w in bare if w not in _STOP), ()
    parts = [[w for w in re.findall(r"\+?[^\W_]+(?:['-][^\W_]+)*\.?", p) if w.strip(".") not in TITLES] for p in plain.split(",")]
    parts = [p for p in parts if p]
    readings = []

    def given(ws: list[str]) -> tuple[str, ...]:
        out: list[str] = []
        for w in ws:
            out += list(w[1:]) if w.startswith("+") else [w.strip(".")]
        return tuple(out)

    def family(ws: list[str]) -> str:
        return " ".join(w.strip(".+") for w in ws)

    if len(parts) > 1:
        readings.append((family(parts[0]), given(sum(parts[1:], []))))
    elif parts:
        ws = parts[0]
        n = len(ws)
        # particles join the word after them
        joined: list[list[str]] = []
        for w in ws:
            if joined and joined[-1][-1].strip(".") in PARTICLES:
                joined[-1].append(w)
            else:
                joined.append([w])
        if n == 1:
            readings.append((family(ws), ()))
        else:
            last, first = joined[-1], joined[0]
            if len(last[-1].strip(".+")) > 1 and not last[-1].startswith("+"):
                readings.append((family(last), given(sum(joined[:-1], []))))
            if len(first[-1].strip(".+")) > 1 and not first[-1].startswith("+"):
                readings.append((family(first), given(sum(joined[1:], []))))
    acronym = tuple(w[1:] for w in words if w.startswith("+"))
    return "person", tuple((s, g) for s, g in readings if len(s) > 1), (acronym, tuple(w for w in bare if not w.startswith("+")))


def _given(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Agreement of given names: 0 if they can't be one person's."""
    if not a or not b:
        return 0.0 if a or b else 0.9
    score = 1.0
    for k, (x, y) in enumerate(zip(a, b)):
        if x == y:
            continue
        fx, fy = SHORT.get(x, x), SHORT.get(y, y)
        if len(x) == 1 or len(y) == 1:
            if x[0] != y[0] and fx[0] != fy[0] and fx[0] != y[0] and x[0] != fy[0]:
                return 0.0
            score -= 0.1
        elif fx == fy:
            score -= 0.05
        elif any(osa(p, q, 1) <= 1 and max(len(p), len(q)) > 3 and min(len(p), len(q)) > 2 for p, q in ((x, y), (fx, fy), (x, fy), (fx, y))):
            score -= 0.2
        else:
            return 0.0
    return score - 0.03 * abs(len(a) - len(b))


def _abbreviates(short: str, long: str) -> bool:
    if not short or short[0] != long[0] or len(short) > len(long):
        return False
    it = iter(long)
    return all(c in it for c in short)


def _orgs(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    left, score, typos = list(b), 1.0, 0
    if len(a) != len(b):
        return 0.0
    for x in a:
        if x in left:
            left.remove(x)
    rest = list((Counter(a) - Counter(b)).elements())
    for x in rest:
        for y in left:
            if osa(x, y, 1) <= 1 and min(len(x), len(y)) > 3:
                typos += 1
                score -= 0.2
                break
            if (_abbreviates(x, y) or _abbreviates(y, x)) and min(len(x), len(y)) >= 2 and max(len(x), len(y)) <= 14:
                score -= 0.05
                break
        else:
            return 0.0
        left.remove(y)
    return score if typos <= 2 else 0.0


def _acronym(org: tuple[str, ...], acronym: tuple[str, ...], rest: tuple[str, ...]) -> float:
    if len(acronym) != 1 or not rest:
        return 0.0
    place = [w for w in org if any(osa(w, r, 1) <= 1 for r in rest)]
    initials = "".join(w[0] for w in org if w not in place)
    return 0.85 if len(place) == len(rest) and initials == acronym[0] else 0.0


def similarity(a: str, b: str) -> float:
    """How likely two folded names are one entity's, part by part; 0 if they can't be."""
    if a == b:
        return 1.0
    pa_, pb = parse(a), parse(b)
    if pa_[0] == "org" and pb[0] == "org":
        return _orgs(pa_[1], pb[1])
    if pa_[0] != pb[0]:
        org, other = (pa_, pb) if pa_[0] == "org" else (pb, pa_)
        return _acronym(org[1], *other[2])
    if pa_[2][0] and pa_[2] == pb[2]:
        return 0.9
    best = 0.0
    for s1, g1 in pa_[1]:
        for s2, g2 in pb[1]:
            d = osa(s1, s2, 1)
            if d == 0 or d == 1 and min(len(s1), len(s2)) > 5:
                g = _given(g1, g2)
                # a slip in the surname needs a given name that agrees
                if g and (d == 0 or g >= 0.75):
                    best = max(best, g - 0.15 * d)
    return max(best, 0.0)


def grams(key: str) -> list[str]:
    out: list[str] = []
    for w in re.findall(r"[^\W_]+", key):
        if w in _STOP or w in TITLES:
            continue
        w = f"^{w}$"
        out += [w[i:i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]
    return sorted(set(out))


@lru_cache(maxsize=100_000)
def _family_bits(s: str) -> int:
    """Bits of a surname: of its letter pairs, or a hash where it is too short to hold a slip."""
    if len(s) <= 5:
        return xxhash.xxh3_64_intdigest(s) & MASK
    v, w = 0, f"^{s}$"
    for i in range(len(w) - 1):
        v |= 1 << (ord(w[i]) * 131 + ord(w[i + 1]) * 17) % 63
    return v


def _shape_bits(letters: list[str]) -> int:
    """Bits of the first letters of words, as often as they occur, and of their number."""
    v = 0
    for c, n in Counter(letters).items():
        for k in range(n):
            v |= 1 << (ord(c) * 31 + k * 7) % 40
    return v | (len(letters) * 0x9E3779B1 & 0x7FFFFF) << 40


def _given_bits(g: tuple[str, ...]) -> int:
    """Bits of the letters with which a first given name, or what it is short for, may begin after one slip; one bit of its own for none."""
    if not g:
        return 1 << 30
    v = 0
    for x in (g[0], SHORT.get(g[0], g[0])):
        for c in x[:2]:
            v |= 1 << ord(c) % 30
    return v


@lru_cache(maxsize=100_000)
def signature(key: str) -> tuple[int | None, int | None, int | None, int]:
    """Bits of the surname of each reading of a person, of the words of an organisation or acronym, and of the given names of both readings.

    ``similarity`` above 0 implies that a surname of one name and one of the other, or the words of both,
    differ in at most SLIP_BITS: one edit changes 3 letter pairs of each surname at most, organisations have
    at most two slips, and an acronym stands for as many words as it has letters. Where more than three words
    follow an acronym their slips are not bounded: the third value is negative, which stands for any. It also
    implies that the given names beside such surnames share a bit: equal ones, initials and short forms share their
    first letter, and one slip leaves one of the first two letters of both in common. The bits of the second reading
    are shifted by 32.
    """
    kind = parse(key)
    if kind[0] == "org":
        return None, None, _shape_bits([w[0] for w in kind[1]]), 0
    given: dict[int, int] = {}
    for s, g in kind[1]:
        f = _family_bits(s)
        given[f] = given.get(f, 0) | _given_bits(g)
    families = sorted(given)
    acronyms, rest = kind[2]
    shape = None if not acronyms else -1 if len(rest) > 3 else _shape_bits([*"".join(acronyms), *(w[0] for w in rest)])
    bits = sum(given[f] << 32 * k for k, f in enumerate(families[:2]))
    return families[0] if families else None, families[1] if len(families) > 1 else None, shape, bits


def _edits(w: str, least: int) -> set[str]:
    """The word and, from ``least`` letters on, its forms without one letter: words an edit or a swap apart have one in common."""
    return {w} | ({w[:i] + w[i + 1:] for i in range(len(w))} if len(w) >= least else set())


def _h(role: str, *parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join([role, *map(str, parts)])) - (1 << 63)


def _letters(given: str) -> set[str]:
    return {given[0], SHORT.get(given, given)[0]}


#: Kinds of posts: the two readings of a person, equal acronyms, a name with an acronym, an organisation that may have one, its words.
_READING, _SAME, _SHORT_ORG, _LONG_ORG, _WORD = 1, 2, 3, 4, 5


def posts(key: str) -> Iterator[tuple[int, int, int, int, str | None]]:
    """(kind, k, own, bits, word) of a folded name: ``similarity`` above 0 implies a key k in common, or related words of two organisations.

    ``own`` is the key of the undamaged surname, so names with equal ones can be paired at that key alone; ``bits``
    are those of the given names, -1 for any. Of an organisation's words, own is the shape and bits their number.
    """
    kind = parse(key)
    if kind[0] == "org":
        words = kind[1]
        n = len(words)
        for w in set(words):
            yield _WORD, 0, _shape_bits([x[0] for x in words]), n, w
            if 3 <= n <= 7 and words.count(w) == 1:
                initials = "".join(x[0] for x in words if x != w)
                for e in _edits(w, 1):
                    yield _LONG_ORG, _h("1", initials, e), 0, -1, None
            if n >= 4:
                for e in _edits(w, 1):
                    yield _LONG_ORG, _h("m", n, e), 0, -1, None
        return
    for r, (s, g) in enumerate(kind[1]):
        own, bits = _h("s", s), _given_bits(g)
        for e in _edits(s, 6):
            yield r, _h("s", e), own, bits, None
    acronyms, rest = kind[2]
    if acronyms:
        yield _SAME, _h("a", *acronyms, "", *rest), _h("a", *acronyms, "", *rest), -1, None
    if len(acronyms) == 1:
        for w in set(rest):
            for e in _edits(w, 1):
                yield _SHORT_ORG, _h("1", acronyms[0], e) if len(rest) == 1 else _h("m", len(acronyms[0]) + len(rest), e), 0, -1, None


#: Roles of split posts: no or one given name, an initial; one in full; several, the first an initial; the first in full;
#: the first two as initials; either in full; both in full; a given name itself.
_ONE, _ONE_FULL, _MORE, _MORE_FULL, _II, _IF, _FI, _FF, _GIVEN = range(9)


def split_posts(key: str, hot: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(role, k, own, hot keys) in place of the keys of each reading that too many names have.

    Given names agree place by place. Two in full at one place share a key of that name; else one of them is an initial at each of
    the first two places that both have, and they share its letter.
    """
    for r, (s, g) in enumerate(parse(key)[1]):
        ks = [k for i, k in hot if i == r]
        own = _h("s", s)
        for k in ks:
            for c in _letters(g[0]) if g else [""]:
                yield _ONE if not g or len(g[0]) == 1 and len(g) == 1 else _ONE_FULL if len(g) == 1 else _MORE if len(g[0]) == 1 else _MORE_FULL, _h("i", k, c), _h("i", own, c), []
                for c2 in _letters(g[1]) if len(g) > 1 else ():
                    yield _II + 2 * (len(g[0]) > 1) + (len(g[1]) > 1), _h("j", k, c, c2), _h("j", own, c, c2), []
        for at, x in enumerate(g[:2]):
            if ks and len(x) > 1:
                for e in _edits(x, 4) | _edits(SHORT.get(x, x), 4):
                    yield _GIVEN, _h("g", at, e), _h("g", at, x), ks


def _hot(p: DataFrame) -> DataFrame:
    """Keys of more than about HOT names; any choice gives the same pairs, as both names of a pair see it."""
    return materialize(p.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > HOT).select("k"))


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def candidates(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ``keys`` (id, key) that can have a similarity above 0, and few others.

    A key stands for nearly a whole surname, so the names that share one stay few however many names there are; where
    they don't (given names read as surnames, a family of a third of all names) the given name splits them.
    """
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in posts(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["id", "kind", "k", "own", "bits", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, key, hot in zip(*(c.to_pylist() for c in batch.columns)) for p in split_posts(key, [(h["kind"], h["k"]) for h in hot])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["id", "role", "k", "own", "hot"])

    every = materialize(keys.select("id", "key").mapInArrow(post, "id bigint, kind tinyint, k bigint, own bigint, bits int, w string"))
    meet = "x.k = y.k and x.id < y.id"
    once = "(x.own != y.own or x.own = x.k)"  # equal surnames share all their keys
    people = every.where(F.col("kind") <= _SAME).select("k", "id", "own", "bits")
    hot = _hot(every.where(F.col("kind") <= _READING))
    cold = people.join(hot, "k", "left_anti")
    out = cold.alias("x").join(cold.alias("y"), F.expr(f"{meet} and {once} and (x.bits & y.bits) != 0")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if not hot.isEmpty():
        held = every.where(F.col("kind") <= _READING).join(hot, "k").groupBy("id").agg(F.collect_list(F.struct("kind", "k")).alias("h"))
        parts = materialize(held.join(keys, "id").select("id", "key", "h").mapInArrow(split, "id bigint, role tinyint, k bigint, own bigint, hot array<bigint>"))
        some = lambda *roles: parts.where(F.col("role").isin(*roles)).select("role", "k", "id", "own")
        beside = lambda x, y: some(*x).alias("x").join(some(*y).alias("y"), F.expr(f"x.k = y.k and x.id != y.id and {once}")).select("x.id", F.col("y.id").alias("b"))
        initials = beside([_ONE], [_ONE, _ONE_FULL, _MORE, _MORE_FULL]).union(beside([_ONE_FULL], [_MORE])).union(beside([_II], [_II, _IF, _FI, _FF])).union(beside([_IF], [_FI]))
        given = parts.where(F.col("role") == _GIVEN).select("k", "id", "own", "hot")
        common = _hot(given)
        rare = given.join(common, "k", "left_anti")
        named = rare.alias("x").join(rare.alias("y"), F.expr(f"{meet} and {once} and arrays_overlap(x.hot, y.hot)"))
        both = given.join(common, "k").select("id", "k", F.explode("hot").alias("s")).select("id", F.xxhash64("k", "s").alias("k"))
        whole = both.alias("x").join(both.alias("y"), F.expr(meet))
        out = out.union(_ordered(initials, "id", "b")).union(_ordered(named, "x.id", "y.id")).union(_ordered(whole, "x.id", "y.id"))
    acronyms = every.where(F.col("kind") == _SHORT_ORG).select("k", "id").alias("x").join(every.where(F.col("kind") == _LONG_ORG).select("k", "id").alias("y"), F.expr("x.k = y.k"))
    words = every.where(F.col("kind") == _WORD).select("id", "w", F.col("own").alias("shape"), F.col("bits").alias("n"))
    return out.union(_ordered(acronyms, "x.id", "y.id")).union(_organisations(words)).distinct()


def related_words(words: DataFrame) -> DataFrame:
    """(w, v): each of ``words`` (w) with itself and all others that one slip or an abbreviation leads to."""
    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, _h("w", e)) for w in batch.column(0).to_pylist() for e in _edits(w, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["w", "e"])

    def letters(v: list[str]) -> np.ndarray:
        out = []
        for w in v:
            seen: Counter = Counter()
            m = 0
            for c in w:
                m |= 1 << (ord(c) * 5 + seen[c] * 29) % 63
                seen[c] += 1
            out.append(m)
        return np.array(out, np.int64)

    def abbreviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple[str, str]] = []
                for u, v in ((x, y),) if same else ((x, y), (y, x)):
                    n, m = np.array([len(w) for w in u]), np.array([len(w) for w in v])
                    i, j = np.nonzero(((letters(u)[:, None] & ~letters(v)[None, :]) == 0) & (n[:, None] <= m[None, :]))
                    out += [(u[k], v[q]) for k, q in zip(i.tolist(), j.tolist()) if u[k] != v[q] and _abbreviates(u[k], v[q])]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["w", "v"])

    forms = materialize(words.where("length(w) >= 4").select("w").mapInArrow(edits, "w string, e bigint"))
    slips = forms.alias("x").join(forms.alias("y"), F.expr("x.e = y.e and x.w != y.w")).select("x.w", F.col("y.w").alias("v")).distinct()
    begin = words.where("length(w) between 2 and 14").select("w", F.substring("w", 1, 1).alias("c"))
    count = begin.groupBy("c").agg(F.ceil(F.count("*") / WORD_BLOCK).cast("int").alias("of"))
    blocks = materialize(begin.join(count, "c").withColumn("p", F.pmod(F.xxhash64("w"), F.col("of")).cast("int")).groupBy("c", "p").agg(F.first("of").alias("of"), F.collect_list("w").alias("vx")))
    pairs = blocks.select("c", "p", "vx", F.explode(F.sequence("p", F.col("of") - 1)).alias("q")).join(blocks.select("c", F.col("p").alias("q"), F.col("vx").alias("vy")), ["c", "q"])
    pairs = pairs.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "p", "q")
    short = pairs.select((F.col("p") == F.col("q")).alias("same"), "vx", "vy").mapInArrow(abbreviations, "w string, v string")
    return materialize(slips.union(short).union(short.select("v", "w")).union(words.select("w", F.col("w").alias("v"))).distinct())


def _organisations(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of organisations; all words of one must be related to words of the other, so each is looked up by that of its words that leads to the fewest."""
    df = materialize(words.groupBy("w").agg(F.count("*").alias("df")))
    rel = related_words(df)
    reach = rel.join(df.select(F.col("w").alias("v"), "df"), "v").groupBy("w").agg(F.sum("df").alias("reach"))
    probe = words.join(reach, "w").groupBy("id").agg(F.min(F.struct("reach", "w")).alias("p"), F.first("n").alias("n"), F.first("shape").alias("shape"))
    probe = probe.select("id", F.col("p.w").alias("w"), "n", "shape").join(rel, "w")
    met = probe.alias("x").join(words.alias("y"), F.expr(f"x.v = y.w and x.n = y.n and x.id != y.id and bit_count(x.shape ^ y.shape) <= {SLIP_BITS}"))
    return _ordered(met, "x.id", "y.id")


def linked_pairs(keys: DataFrame, cosine: float = COSINE, top_n: int | None = None) -> DataFrame:
    """(a, b, cosine, sim) of the names of ``keys`` (id, key) with a cosine of at least ``cosine`` and sim > 0; a < b."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, g) for i, k in zip(batch.column(0).to_pylist(), range(batch.num_rows)) for g in grams(batch.column(1)[k].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["id", "gram"])

    grammed = keys.select("id", "key").mapInArrow(explode, "id bigint, gram string")
    n = keys.count()
    df = grammed.groupBy("gram").agg(F.count("*").alias("df"))
    # weights of a name by gram; names are short, so the list per name is
    vector = grammed.join(df, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("v")).join(keys, "id")
    vector = materialize(vector.select("id", "key", "v"))
    pairs = candidates(vector.select("id", "key"))
    key = vector.select("id", "key")
    pairs = pairs.join(key.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(key.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], ["a", "b", "sim"]).filter(pc.greater(s, 0.0))

    # few pairs are left; only they need the full vectors for the cosine
    out = pairs.select("a", "b", "ka", "kb").mapInArrow(compare, "a bigint, b bigint, sim double")
    slim = vector.select("id", F.transform("v", lambda x: x["df"]).alias("df"), F.transform("v", lambda x: x["gram"]).alias("g"))
    out = out.join(slim.select(F.col("id").alias("a"), F.col("df").alias("da"), F.col("g").alias("ga")), "a").join(slim.select(F.col("id").alias("b"), F.col("df").alias("db"), F.col("g").alias("gb")), "b")
    # the weight of a shared gram is a function of its df
    wa = lambda c: F.log((n + 1) / c) + 0.1
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + wa(x) * wa(x)))
    shared = F.aggregate(F.zip_with("ga", "da", lambda g, d: F.when(F.array_contains("gb", g), wa(d) * wa(d)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("cosine", shared / (norm("da") * norm("db"))).where(F.col("cosine") >= cosine).select("a", "b", "cosine", "sim")
    if top_n:
        both = out.select("a", "b", "cosine", "sim").union(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "sim"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
        out = both.withColumn("r", rank).where(F.col("r") <= top_n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine", "sim").distinct()
    return out


def average_linkage(n: int, links: list[tuple[int, int, float]], least: float = LINK) -> list[int]:
    """Cluster of each of n items; missing links count as similarity 0."""
    sim: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, s in links:
        sim[i][j] = sim[j][i] = max(s, sim[i].get(j, 0.0))
    size, held, alive = [1] * n, {i: [i] for i in range(n)}, set(range(n))
    import heapq
    heap = [(-s, i, j) for i in range(n) for j, s in sim[i].items() if i < j]
    heapq.heapify(heap)
    while heap:
        s, i, j = heapq.heappop(heap)
        if i not in alive or j not in alive or sim[i].get(j) is None or abs(sim[i][j] / (size[i] * size[j]) + s) > 1e-12:
            continue
        if -s < least:
            break
        # sums of similarities add up; the average divides by both sizes
        for k, x in sim[j].items():
            if k != i:
                sim[i][k] = sim[i].get(k, 0.0) + x
                sim[k][i] = sim[i][k]
            sim[k].pop(j, None)
        sim[i].pop(j, None)
        size[i] += size[j]
        alive.discard(j)
        held[i] += held.pop(j)
        for k, x in sim[i].items():
            heapq.heappush(heap, (-x / (size[i] * size[k]), min(i, k), max(i, k)))
    label = [0] * n
    for i, members in held.items():
        for x in members:
            label[x] = i
    return label


def linkage_rounds(sims: DataFrame, least: float = LINK) -> DataFrame:
    """(id, entity): average linkage of any number of items over the executors; ``sims`` is (a, b, sim), a < b, missing pairs count as 0.

    In each round all pairs of clusters that are each other's best partner are merged. The average of a merged
    cluster to any other is never above the better one of its parts, so this gives the clusters of merging one
    pair at a time (Bruynooghe's reducibility); equal averages are ordered by the pair's ids in both. No task holds a cluster or a component.
    """
    edges = materialize(sims.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.max("sim").alias("s")))
    nodes = edges.select("u").union(edges.select(F.col("v").alias("u"))).distinct()
    member = materialize(nodes.select(F.col("u").alias("id"), F.col("u").alias("entity")))
    size = member.select(F.col("entity").alias("c"), F.lit(1).cast("bigint").alias("n"))
    while True:
        su, sv = size.select(F.col("c").alias("u"), F.col("n").alias("nu")), size.select(F.col("c").alias("v"), F.col("n").alias("nv"))
        near = edges.join(su, "u").join(sv, "v").select("u", "v", (F.col("s") / (F.col("nu") * F.col("nv"))).alias("avg")).where(F.col("avg") >= least)
        order = F.struct(-F.round("avg", 12), "u", "v")
        both = near.select(F.col("u").alias("x"), order.alias("o")).union(near.select(F.col("v").alias("x"), order.alias("o")))
        best = both.groupBy("x").agg(F.min("o").alias("o")).select("x", "o.u", "o.v")
        # a pair that is the best of both its ends
        merged = materialize(best.groupBy("u", "v").agg(F.count("*").alias("ends")).where("ends = 2").select(F.col("v").alias("c"), F.col("u").alias("into")))
        if merged.isEmpty():
            return member
        to = lambda df, col: df.join(merged.withColumnRenamed("c", col), col, "left").withColumn(col, F.coalesce("into", col)).drop("into")
        e = to(to(edges, "u"), "v").where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "s")
        edges = materialize(e.groupBy("u", "v").agg(F.sum("s").alias("s")))
        size = materialize(to(size, "c").groupBy("c").agg(F.sum("n").alias("n")))
        member = materialize(to(member, "entity").select("id", "entity"))


def similar_in_blocks(names: DataFrame) -> DataFrame:
    """(component, a, b, sim) of all pairs with sim > 0 of each component of ``names`` (component, n, node, key); a < b.

    A task compares two blocks at a time: their signatures first, then the names that are near.
    """
    spread = names.withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("p", F.pmod(F.xxhash64("node", F.lit(7)), F.col("of")).cast("int"))
    blocks = materialize(spread.groupBy("component", "p").agg(F.first("of").alias("of"), F.collect_list(F.struct("node", "key")).alias("v")))
    x = blocks.select("component", F.col("v").alias("vx"), "p", F.explode(F.sequence("p", F.col("of") - 1)).alias("q"))
    pairs = x.join(blocks.select("component", F.col("p").alias("q"), F.col("v").alias("vy")), ["component", "q"]).select("component", "p", "q", "vx", "vy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c, p, q, vx, vy = (col[row].as_py() for col in batch.columns)
                out: list[tuple[int, int, float]] = []
                i, j = np.nonzero(_near(_signs(vx), _signs(vy)))
                for u, w in zip(i.tolist(), j.tolist()):
                    (a, ka), (b, kb) = sorted((tuple(vx[u].values()), tuple(vy[w].values())))
                    if a != b and (p != q or u < w) and (s := similarity(ka, kb)) > 0:
                        out.append((a, b, s))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(out), pa.int64()), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["component", "a", "b", "sim"])

    return pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "p", "q").mapInArrow(run, "component bigint, a bigint, b bigint, sim double")


def _signs(v: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    signs = [signature(x["key"])[:3] for x in v]
    return np.array([[y or 0 for y in s] for s in signs], np.int64).reshape(-1, 3), np.array([[y is not None for y in s] for s in signs], bool).reshape(-1, 3)


def _near(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which names of two blocks ``similarity`` may link."""
    out = np.zeros((len(x[0]), len(y[0])), bool)
    for p, q in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 2)):
        a, b = x[0][:, p, None], y[0][None, :, q]
        near = np.bitwise_count((a ^ b) & MASK) <= SLIP_BITS
        out |= (near | (a < 0) | (b < 0)) & x[1][:, p, None] & y[1][None, :, q]
    return out


def entities(authors: DataFrame, name_col: str = "author", cosine: float = COSINE, link: float = LINK) -> DataFrame:
    """(name, entity) of every different name of ``authors``; names of one entity are its variants."""
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(x) for x in batch.column(0).to_pylist()], pa.string())], ["name", "key"])

    names = authors.select(F.col(name_col).alias("name")).where(f"`{name_col}` is not null").distinct().mapInArrow(folded, "name string, key string")
    names = materialize(names.where("key rlike '[^\\\\W_]'").withColumn("id", F.xxhash64("key")))
    keys = names.select("id", "key").distinct()
    links = materialize(linked_pairs(keys, cosine))
    member = materialize(connected_components(links))
    grouped = links.join(member.select(F.col("node").alias("a"), "component"), "a").join(keys.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(keys.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b").select("component", "a", "b", "ka", "kb", "sim")
    large = member.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > FULL_COMPARISON)
    apart = None
    if not large.isEmpty():  # compared in blocks and clustered in rounds, over the executors
        inside = member.join(large, "component").join(keys.withColumnRenamed("id", "node"), "node")
        grouped = grouped.join(large, "component", "left_anti")
        apart = linkage_rounds(similar_in_blocks(inside).select("a", "b", "sim"), link)

    def cluster(rows: list[tuple]) -> list[tuple[int, int]]:
        ids = sorted({r[1] for r in rows} | {r[2] for r in rows})
        at = {x: k for k, x in enumerate(ids)}
        sims = {(at[a], at[b]): s for _, a, b, _, _, s in rows}
        # pairs below the cosine threshold have a similarity too
        key = {r[1]: r[3] for r in rows} | {r[2]: r[4] for r in rows}
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if (i, j) not in sims and (j, i) not in sims and (s := similarity(key[ids[i]], key[ids[j]])) > 0:
                    sims[i, j] = s
        label = average_linkage(len(ids), [(i, j, s) for (i, j), s in sims.items()], link)
        return [(x, ids[k]) for x, k in zip(ids, label)]

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int]] = []
        held: list[tuple] = []
        for batch in batches:  # sorted, so a component's rows follow each other, maybe over batches
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    done += cluster(held)
                    held = []
                held.append(row)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], ["id", "entity"])
                done = []
        if held:
            done += cluster(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], ["id", "entity"])

    parts = int(authors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grouped.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(clusters, "id bigint, entity bigint")
    found = found if apart is None else found.unionByName(apart)
    return names.join(found, "id", "left").select("name", F.coalesce("entity", "id").alias("entity"))


def variants(authors: DataFrame, name_col: str = "author") -> DataFrame:
    """(author_a, author_b): all pairs of different values of one entity, the lesser first."""
    e = materialize(entities(authors, name_col))
    a, b = e.select(F.col("name").alias("author_a"), "entity"), e.select(F.col("name").alias("author_b"), F.col("entity").alias("eb"))
    return a.join(b, F.expr("entity = eb and author_a < author_b")).select("author_a", "author_b")


def partners(authors: DataFrame, name_col: str = "author", n: int = 5) -> DataFrame:
    """(key, partner, cosine, rank): the n most similar partners of each folded name, ties by the partner's id; a report.

    The top-n form of the cosine join; ``entities`` keeps all partners, as a cap could lose links.
    """
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(x) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

    keys = authors.select(F.col(name_col).alias("name")).where(f"`{name_col}` is not null").distinct().mapInArrow(folded, "key string")
    keys = materialize(keys.where("key rlike '[^\\\\W_]'").distinct().withColumn("id", F.xxhash64("key")).select("id", "key"))
    links = materialize(linked_pairs(keys, top_n=n))
    both = links.select("a", "b", "cosine").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= n)
    k = lambda c, name: keys.select(F.col("id").alias(c), F.col("key").alias(name))
    return ranked.join(k("a", "key"), "a").join(k("b", "partner"), "b").select("key", "partner", "cosine", "rank")
