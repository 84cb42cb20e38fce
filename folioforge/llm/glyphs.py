"""One consistent form for values that look alike but differ in characters (problem 4).

Method: a transducer over grapheme clusters. Its mapping is computed once from the Unicode data and a
short list of look-alikes, checked for conflicts (no source with two outputs, no output that is
itself a source) and compiled to one automaton for each target script, a trie whose states hold their output.
A value is rewritten in one pass from left to right: from each position the longest match is taken and must end
where a cluster ends; the few clusters with marks that no source has are compiled when they are met, so each is
worked out once. Look-alike letters depend on their word, which chooses the automaton: the word's script is that
of its letters that look like no other script's, and only letters foreign to it are replaced.

Rewritten: widths, spaces, invisible characters, decomposed letters, singletons such as the Kelvin
sign, ligatures and letter-like compatibility forms, look-alikes. Kept: typographic quotes and dashes,
Greek symbols, superscripts, words wholly in another script, joiners where a script needs them.

Defined results: null stays null, empty stays empty, the form of a form is the form itself.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts drawn like Latin letters.
CYRILLIC_LIKE = dict(zip("аеорсухіѕјһԁԛԝѵґӏАВЕКМНОРСТУХІЅЈԌԚԜҮһ", "aeopcyxisjhdqwvrlABEKMHOPCTYXISJGQWYh"))
GREEK_LIKE = dict(zip("ονρικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpikuABEZHIKMNOPTYX"))
ARMENIAN_LIKE = dict(zip("օսհոց", "ouhng"))
#: Greek small letters that stand beside Latin letters as symbols are replaced only inside longer words.
LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_LIKE.items() if k in "аеорсухАВЕКМНОРСТУХ"}

_JOINER_SCRIPTS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Gurmukhi}\p{Sinhala}\p{Khmer}\p{Emoji_Presentation}\p{Extended_Pictographic}]")


def _build() -> dict[str, str]:
    """Context-free part of the table, by rule over all code points."""
    t: dict[str, str] = {}

    def put(src: str, out: str) -> None:
        if src == out:
            return
        if t.get(src, out) != out:
            raise ValueError(f"conflict for {src!r}: {t[src]!r} and {out!r}")
        t[src] = out

    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        d = unicodedata.decomposition(ch)
        kind = d.split(">")[0][1:] if d.startswith("<") else ""
        if cat == "Zs":
            put(ch, " ")
        elif cat == "Cf" and not 0x600 <= cp < 0x900 and not 0x110BD <= cp <= 0x110CD or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E) or 0xFE00 <= cp <= 0xFE0F:
            put(ch, "")
        elif kind in ("wide", "narrow") or kind == "font" or kind == "compat" and cat[0] == "L" and cp >= 0xFB00 and cp < 0xFB07 or 0x2160 <= cp <= 0x217F or cp == 0x2011:
            put(ch, "-" if cp == 0x2011 else unicodedata.normalize("NFKC", ch))
        elif unicodedata.normalize("NFC", ch) != ch:
            put(ch, unicodedata.normalize("NFC", ch))
        full = unicodedata.normalize("NFD", ch)
        if len(full) > 1 and unicodedata.normalize("NFC", full) == ch and not 0xAC00 <= cp < 0xD7A4:
            put(full, ch)
            if len(full) > 2 and len(unicodedata.normalize("NFC", full[:2])) == 1:
                put(unicodedata.normalize("NFC", full[:2]) + full[2:], ch)
    for src, out in t.items():  # outputs pass unchanged
        if any(c in t for c in out):
            t[src] = "".join(t.get(c, c) for c in out)
    for src, out in t.items():
        if any(c in t for c in out):
            raise ValueError(f"{src!r} gives {out!r}, which is itself a source")
    return t


_TABLE: dict[str, str] = {}
_SUSPECT = regex.compile(r"[^\x00-\x7f]")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}­​-‏⁠-⁤﻿]+")
_CLUSTER = regex.compile(r"\X")
_LIKE = {**CYRILLIC_LIKE, **GREEK_LIKE, **ARMENIAN_LIKE}
_OUT = ""


class Transducer:
    """The mapping for words of one target script ("L" Latin, "C" Cyrillic, "" none), compiled to a trie."""

    def __init__(self, table: dict[str, str], target: str) -> None:
        self.table, self.target, self.root = table, target, {}
        for source in table:
            self._add(source)
        for ch in _LIKE if target == "L" else LATIN_TO_CYRILLIC if target == "C" else ():
            self._add(ch)

    def _add(self, source: str) -> str:
        node = self.root
        for ch in source:
            node = node.setdefault(ch, {})
        node[_OUT] = out = self._output(source)
        return out

    def _output(self, cluster: str) -> str:
        """What stands for a cluster: its own entry, or those of its characters, composed."""
        full = unicodedata.normalize("NFD", cluster)
        if self.target == "L" and len(full) > 1 and full[0] in _LIKE:
            return unicodedata.normalize("NFC", _LIKE[full[0]] + "".join(self.table.get(x, x) for x in full[1:]))
        hit = self.table.get(cluster)
        if hit is not None:
            return hit
        keep = len(cluster) > 1 and _JOINER_SCRIPTS.search(cluster) is not None
        like = _LIKE if self.target == "L" else LATIN_TO_CYRILLIC if self.target == "C" else {}
        out = "".join(like[c] if c in like else c if keep else self.table.get(c, c) for c in cluster)
        return unicodedata.normalize("NFC", out) if len(out) > 1 else out

    def run(self, text: str, out: list[str]) -> None:
        """Append the rewritten text to ``out``."""
        root, i, n = self.root, 0, len(text)
        while i < n:
            node, j, end, hit = root, i, i + 1, None
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if _OUT in node:
                    end, hit = j, node[_OUT]
            if end < n and text[end] > "\x7f" and (k := _CLUSTER.match(text, i).end()) != end and k > end:
                end, hit = k, self._add(text[i:k])  # marks that no source has
            out.append(text[i:end] if hit is None else hit)
            i = end


_COMPILED: dict[str, Transducer] = {}


def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFF21 <= cp <= 0xFF5A:
        return "L" if ch.isalpha() else ""
    if 0x370 <= cp < 0x400:
        return "G"
    if 0x400 <= cp < 0x530:
        return "C"
    if 0x530 <= cp < 0x590:
        return "A"
    return "L" if cp in (0x212A, 0x212B) or 0xFB00 <= cp < 0xFB07 else "O" if ch.isalpha() else ""


def _word_target(word: str, latin_around: bool, beside_hyphen: bool) -> str:
    """Script whose look-alikes replace foreign letters in this word; empty if none do."""
    n = {"L": 0, "C": 0, "G": 0, "A": 0, "O": 0}
    sure = dict(n)
    for ch in word:
        s = _script(ch)
        if s:
            n[s] += 1
            sure[s] += not (s in "CGA" and ch in _LIKE) and not (s == "L" and ch in LATIN_TO_CYRILLIC)
    kinds = [s for s in "LCGA" if n[s]]
    if n["O"] or not kinds or kinds == ["L"]:
        return ""
    if len(kinds) == 1:
        # a word wholly of look-alikes within Latin text; Greek symbols stand alone or by a hyphen
        only = kinds[0]
        alike = all(c in _LIKE for c in word if _script(c))
        if alike and latin_around and not (only == "G" and (beside_hyphen or n["G"] == 1 and word.strip("​⁠﻿­").islower())):
            return "L"
        return ""
    if n["L"] and not sure["C"] and not sure["G"] and not sure["A"]:
        return "L"
    if n["C"] and sure["C"] > sure["L"]:
        return "C"
    return "L" if n["L"] else ""


@lru_cache(maxsize=200_000)
def form(value: str | None) -> str | None:
    """The consistent form of one value."""
    if not value or not _SUSPECT.search(value):
        return value
    if not _COMPILED:
        _TABLE.update(_build())
        _COMPILED.update({t: Transducer(_TABLE, t) for t in ("", "L", "C")})
    words = list(_WORD.finditer(value))
    latin_around = sum(any(_script(c) == "L" for c in m.group()) for m in words) * 2 >= len(words) - 1 and \
        not any(sum(_script(c) == "C" and c not in _LIKE for c in m.group()) > 1 for m in words)
    out: list[str] = []
    pos = 0
    for m in words:
        s, e = m.span()
        if pos < s:
            _COMPILED[""].run(value[pos:s], out)
        w = m.group()
        if w.isascii():
            out.append(w)
        else:
            hyphen = value[e:e + 1] in ("-", "‐", "‑") or s > 0 and value[s - 1] in "-‐‑"
            _COMPILED[_word_target(w, latin_around, hyphen)].run(w, out)
        pos = e
    if pos < len(value):
        _COMPILED[""].run(value[pos:], out)
    return "".join(out)


def forms(df: DataFrame, id_col: str, fields: list[str], only_changed: bool = False) -> DataFrame:
    """(field_name, row_id, value, form) of every non-null value; plain ASCII never leaves the JVM.

    A map over partitions without a shuffle.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("row_id"), *[F.col(f).cast("string").alias(f"v{k}") for k, f in enumerate(fields)])
    pairs = ", ".join(f"'{f}', v{k}" for k, f in enumerate(fields))
    long = base.select("row_id", F.expr(f"stack({len(fields)}, {pairs}) as (field_name, value)")).where("value is not null")
    odd = F.col("value").rlike(r"[^\x00-\x7F]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([form(v) for v in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), done], ["row_id", "field_name", "value", "form"])

    rewritten = long.where(odd).mapInArrow(run, "row_id bigint, field_name string, value string, form string")
    if only_changed:
        return rewritten.where("value != form")
    return rewritten.unionByName(long.where(~odd).withColumn("form", F.col("value")))
