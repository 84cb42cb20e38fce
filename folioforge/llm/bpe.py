"""Encode a corpus with a public byte-level BPE vocabulary (problem 7).

Method: all vocabulary entries are compiled into one Aho-Corasick automaton. One pass over a
pre-token's bytes gives every vocabulary match by its start; the encoder takes the longest match,
checks it against its left neighbour in the pair-compatibility table and backs off to the next
shorter match where the pair could not stand side by side in a merged text. A position from which
no continuation exists is marked and never tried again (a prefix has only one encoding), so the time
is linear in the matches. The result equals the one of running the merges in rank order.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; the output has one row per input row, repeated rows included.
"""
from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_ENTRIES = 400_000


def _pretoken_pattern() -> re.Pattern:
    """The vocabulary's published split pattern with its letter and number classes spelt out for ``re``."""
    other_numbers, start = [], None
    for cp in range(sys.maxunicode + 2):
        hit = cp <= sys.maxunicode and unicodedata.category(chr(cp)) in ("No", "Nl")
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            other_numbers.append((start, cp - 1))
            start = None
    n = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in other_numbers)
    # \w of re is alnum plus underscore; numbers outside Nd are taken out of the letters
    letter, number = rf"[^\W\d_{n}]", rf"[\d{n}]"
    other = rf"(?:[^\s\w]|_)"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+")


class Encoder:
    """Exact encoder and decoder for one vocabulary file; built once per Python worker."""

    def __init__(self, path: str = DEFAULT_VOCAB) -> None:
        import ahocorasick

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        special = {i for t, i in model["vocab"].items() if t.startswith("<|")}
        self.id_of = {b.decode("latin-1"): i for b, i in vocab.items() if i not in special}
        ordered = sorted((i, b) for b, i in vocab.items() if i not in special)
        self.blob = b"".join(b for _, b in ordered)
        self.offsets = np.zeros(ordered[-1][0] + 2, np.int64)
        for i, b in ordered:
            self.offsets[i + 1] = len(b)
        self.offsets = np.cumsum(self.offsets)
        self.left, self.right, self.pair = {}, {}, {}
        tok = model["vocab"]
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            t = tok[a + b]
            if (tok[a], tok[b]) not in self.pair:
                self.pair[tok[a], tok[b]] = t
                self.left.setdefault(t, tok[a])
                self.right.setdefault(t, tok[b])
        self.match = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.match.add_word(s, (i, len(s)))
        self.match.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pattern = _pretoken_pattern()
        self._words: dict[str, bytes] = {}
        self.mid, self.head = _Cache(self, " "), _Cache(self, "")
        self.mid_n, self.head_n = _Sizes(self.mid), _Sizes(self.head)

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b can be neighbours in a text merged by rank.

        The merges around the boundary are undone from the last to the first; if at some time a merge
        across it had a better rank than what came next, the pair could not have come about.
        """
        key = (a, b)
        known = self.compatible.get(key)
        if known is not None:
            return known
        before, ok = 1 << 60, True
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            if a > b and a in self.left:
                before, a = a, self.right[a]
            elif b in self.left:
                before, b = b + 1, self.left[b]
            else:
                break
        if len(self.compatible) > 4 * CACHE_ENTRIES:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def pretoken(self, s: str) -> list[int]:
        """Ids of one pre-token, given as its UTF-8 bytes in Latin-1 characters."""
        whole = self.id_of.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, k) in self.match.iter(s):
            at[end - k + 1].append((i, end + 1))  # by growing length
        dead = bytearray(n + 1)
        out: list[int] = []
        came: list[tuple[int, int]] = []  # start and choice of each token taken
        pos, choice = 0, len(at[0]) - 1
        while pos < n:
            while choice >= 0:
                i, nxt = at[pos][choice]
                if not dead[nxt] and (not out or self.fits(out[-1], i)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(i)
                came.append((pos, choice))
                pos = nxt
                choice = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                out.pop()
                pos, choice = came.pop()
                choice -= 1
        return out

    def _word(self, w: str) -> bytes:
        ids = self._words.get(w)
        if ids is None:
            if len(self._words) > CACHE_ENTRIES:
                self._words.clear()
            ids = np.array(self.pretoken(w.encode("utf-8", "replace").decode("latin-1")), np.int32).tobytes()
            if len(w) <= 64:
                self._words[w] = ids
        return ids

    def unit(self, s: str) -> bytes:
        """Ids (int32 bytes) of a stretch that starts and ends at pre-token boundaries."""
        return b"".join(map(self._word, self.pattern.findall(s)))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian int32 bytes."""
        if not text:
            return b""
        head, *rest = _split(text)
        self.mid.trim(), self.head.trim()
        return self.head[head] + b"".join(map(self.mid.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        head, *rest = _split(text)
        if len(self.mid_n) > CACHE_ENTRIES:
            self.mid_n.clear()
        if len(self.head_n) > CACHE_ENTRIES:
            self.head_n.clear()
        return self.head_n[head] + sum(map(self.mid_n.__getitem__, rest))

    def decode_bytes(self, ids) -> bytes:
        o, blob = self.offsets, self.blob
        return b"".join(blob[o[i]:o[i + 1]] for i in ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Cache(dict):
    """Ids by space-delimited stretch; ``lead`` is the space the split took away."""

    def __init__(self, enc: Encoder, lead: str) -> None:
        self.enc, self.lead = enc, lead

    def __missing__(self, s: str) -> bytes:
        ids = self.enc.unit(self.lead + s)
        if len(s) <= 32:
            self[s] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()


class _Sizes(dict):
    def __init__(self, ids: _Cache) -> None:
        self.enc, self.lead = ids.enc, ids.lead

    def __missing__(self, s: str) -> int:
        n = len(self.enc.unit(self.lead + s)) // 4
        if len(s) <= 32:
            self[s] = n
        return n


_SPACES_MEET = re.compile(r" \s|\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _split(text: str) -> list[str]:
    """Cut at single spaces between two non-spaces: a pre-token always begins there."""
    if _SPACES_MEET.search(text) or text[0] == " " or text[-1] == " ":
        return _LONE_SPACE.split(text)
    return text.split(" ")


_ENCODERS: dict[str, Encoder] = {}
_SENT: set[tuple[str, str]] = set()


def encoder(path: str = DEFAULT_VOCAB) -> Encoder:
    """The encoder of a vocabulary file; on a worker, of the copy that ``send`` gave it."""
    if path not in _ENCODERS:
        sent = Path(SparkFiles.get(Path(path).name)) if SparkFiles._is_running_on_worker else Path(path)
        _ENCODERS[path] = Encoder(str(sent if sent.exists() else path))
    return _ENCODERS[path]


def send(spark: SparkSession, path: str) -> None:
    """Give the executors the vocabulary file, once for each application: they need no copy at that path."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SENT and Path(path).exists():
        sc.addFile(path)
        _SENT.add((sc.applicationId, path))


def encode_table(df: DataFrame, id_col: str, text_col: str, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, ids array<int>) for each row; a map over partitions without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            parts = [enc.encode_bytes(t) for t in b.column(1).to_pylist()]
            offsets = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), np.int32, len(parts) + 1)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    send(df.sparkSession, vocab)
    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_table(df: DataFrame, id_col: str, ids_col: str = "ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, text) from lists of ids; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
