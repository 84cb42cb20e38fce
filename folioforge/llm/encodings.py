"""Find and restore texts decoded with a wrong character encoding (problem 9).

Method: adjacent character pairs are counted over the whole corpus and scored by their smoothed
pointwise mutual information, log n(ab) / (n(a) n(b) / N + K). Within a text, maximum-scoring segments
(all maximal ones, over runs of equal sign) isolate the improbable stretches, and only inside those the
inverse mappings are tried: stretches whose characters are bytes of UTF-8 read in a one-byte code page,
again for text garbled twice, and texts of one code page read in another. A mapping is taken where the
restored characters score better in their surroundings.

Beside it stands ``damaged``, an operator of its own for what no mapping can restore: replacement characters
(U+FFFD) and control codes that no text has are proof of a wrong decoding whatever their score. ``repaired``
gives both with ``how``: "mapping" for rows found by segments and inverse mappings, "damage" for rows that only
hold such characters.

The pair table has a fixed size: characters are folded to at most ``ALPHABET`` = 3,377 classes (single ones
below U+0530 and in the blocks of punctuation and symbols, else the block), so what reaches the driver
and the workers is bounded by ALPHABET squared whatever the corpus' size: 11.4 million counts, of which real
texts have a few ten thousand.

Defined results: null, empty and plain ASCII texts are never affected; lost characters are not restorable,
their texts are affected.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, PUNCT0, PUNCT1 = 0x530, 0x2000, 0x2700
ALPHABET = LOW + (PUNCT1 - PUNCT0) + 257
#: K of the smoothed mutual information, as a share of all pairs.
SMOOTH = 1e-4
#: Nats by which a document's restored runs must score better.
MARGIN = 3.0
#: The same for one-byte pages, in all and for each changed character; prior of a valid UTF-8 sequence.
SINGLE_MARGIN, PER_CHARACTER, UTF8_BONUS = 7.0, 4.0, 4.0
#: The same for East Asian pages, in which many short runs are valid by chance.
ASIAN_MARGIN = 20.0
#: Code pages a UTF-8 text may have been read in, and pairs (read in, written in) of one-byte pages.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "koi8-r", "cp1254")
READ_WRITTEN = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "iso8859-2"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"),
                ("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("latin-1", "iso8859-5"),
                ("cp1251", "cp866"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"))
EAST_ASIAN = (("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("latin-1", "shift_jis"), ("mac_roman", "shift_jis"))


def _class_table() -> np.ndarray:
    c = np.arange(0x110000, dtype=np.int64)
    out = np.where(c < LOW, c, LOW + (PUNCT1 - PUNCT0) + np.minimum(c >> 8, 256))
    return np.where((c >= PUNCT0) & (c < PUNCT1), LOW + c - PUNCT0, out)


_CLASS = _class_table()


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point."""
    return _CLASS[codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n) over all texts; each partition sends its own sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), 500):
                c = classes(_codes("\n".join(t for t in texts[k:k + 500] if t)))
                if len(c) > 1:
                    pair, n = np.unique(c[:-1] * ALPHABET + c[1:], return_counts=True) if len(c) < 50_000 else (None, None)
                    if pair is None:
                        total += np.bincount(c[:-1] * ALPHABET + c[1:], minlength=len(total))
                    else:
                        total[pair] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return df.select(text_col).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Score of adjacent pairs from the corpus' counts."""

    def __init__(self, pair: np.ndarray, n: np.ndarray) -> None:
        total = float(max(n.sum(), 1))
        m = np.zeros((ALPHABET, ALPHABET), np.float32)
        m.ravel()[pair] = n
        left, right = m.sum(1), m.sum(0)
        e = (left[:, None] * (right / total)[None, :]).astype(np.float32)
        e += max(total * SMOOTH, 1.0)
        m += np.float32(max(total * SMOOTH * 1e-3, 0.01))
        m /= e
        np.log(m, out=m)
        self.score = m
        self.readings: dict[str, list] = {}
        #: Characters that clean text has; a class seen less often than this share is not a likely restoration.
        self.seen = (left + right) / (2 * total)

    def text(self, s: str) -> float:
        c = classes(_codes(s))
        return float(self.score[c[:-1], c[1:]].sum()) if len(c) > 1 else 0.0


def maximal_segments(v: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence of scores (Ruzzo and Tompa's definition)."""
    if not len(v) or v.max() <= 0:
        return []
    sign = v > 0
    cut = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    starts = np.concatenate([[0], cut])
    sums = np.add.reduceat(v, starts)
    ends = np.append(starts[1:], len(v))
    # a candidate: left sum, right sum, start, end, index of the last one before it with a smaller left sum
    total, done, stack = 0.0, [], []
    for s, e, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        left, right = before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0:  # nothing earlier can be joined any more
                done += stack
                stack = [(left, right, s, e, -1)]
                break
            if stack[k][1] >= right:
                stack.append((left, right, s, e, k))
                break
            left, s = stack[k][0], stack[k][2]
            del stack[k:]
    return [(c[2], c[3]) for c in done + stack]


def _byte_chars(page: str) -> list[str]:
    """Character of each byte; where a page has none, the control of that number, as decoders do."""
    return [bytes([b]).decode(page, "ignore") or chr(b) for b in range(256)]


class _Utf8In:
    """UTF-8 sequences spelt in the characters of a one-byte page."""

    def __init__(self, page: str) -> None:
        ch = _byte_chars(page)
        self.byte = {c: b for b, c in enumerate(ch) if b >= 0x80}
        if page == "cp1252":  # controls kept by lenient decoders
            self.byte |= {chr(b): b for b in range(0x80, 0xA0)}

        def cls(a: int, b: int) -> str:
            return "[" + "".join(re.escape(c) for c, k in self.byte.items() if a <= k <= b) + "]"

        cont = cls(0x80, 0xBF)
        self.find = re.compile(f"{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}}")

    def decode(self, s: str) -> str | None:
        try:
            return bytes(self.byte[c] for c in s).decode("utf-8")
        except UnicodeDecodeError:
            return None


class _Single:
    """One page read as another, as tables over code points and classes."""

    def __init__(self, read: str, written: str) -> None:
        self.to = np.arange(PUNCT1 + 3, dtype=np.uint32)
        self.to[PUNCT1 + 1:] = BEYOND
        for c, b in ((c, b) for b, c in enumerate(_byte_chars(read)) if b >= 0x80):
            out = bytes([b]).decode(written, "ignore")
            at = int(_slots(np.array([ord(c)]))[0])
            if out and not "\x80" <= out <= "\x9f" and at != PUNCT1:
                self.to[at] = ord(out)
        self.to_class = classes(self.to)
        self.to_class[PUNCT1] = -1  # all beyond the tables


#: The two characters of one-byte pages that lie beyond the tables' range (the ligatures fi and fl).
BEYOND = (0xFB01, 0xFB02)


def _slots(codes: np.ndarray) -> np.ndarray:
    """Index of each code point in the tables; PUNCT1 stands for all that have none."""
    low = np.minimum(codes, PUNCT1)
    if len(codes) and codes.max() >= BEYOND[0]:
        for k, c in enumerate(BEYOND, 1):
            low = np.where(codes == c, PUNCT1 + k, low)
    return low


_UTF8: list[_Utf8In] = []
_SINGLE_TO: np.ndarray
_SINGLE_CLASS: np.ndarray
#: Characters that are bytes of the pages an East Asian text may have been read in.
_IN_ASIAN = np.zeros(PUNCT1 + 1, bool)
_TO_BYTES: dict[str, dict[int, str]] = {}
_CANNOT = re.compile("[\x80-\x9f\ufffd]")


def _setup() -> None:
    for page in UTF8_READ_AS:
        r = _Utf8In(page)
        r.lead, r.cont = np.zeros(PUNCT1 + 1, bool), np.zeros(PUNCT1 + 1, bool)
        for c, k in r.byte.items():
            r.lead[min(ord(c), PUNCT1)], r.cont[min(ord(c), PUNCT1)] = 0xC2 <= k <= 0xF4, k <= 0xBF
        _UTF8.append(r)
    for page in {r for r, _ in EAST_ASIAN}:
        _TO_BYTES[page] = {ord(c): chr(k) for k, c in enumerate(_byte_chars(page)) if ord(c) != k}
        _TO_BYTES[page] |= {k: "\u0100" for k in range(0xA0, 0x100) if chr(k) not in _byte_chars(page)}  # not of the page
        for c in _byte_chars(page)[128:]:
            _IN_ASIAN[min(ord(c), PUNCT1)] |= ord(c) < PUNCT1
    global _SINGLE_TO, _SINGLE_CLASS
    tables = [_Single(*p) for p in READ_WRITTEN]
    _SINGLE_TO = np.stack([t.to for t in tables])
    _SINGLE_CLASS = np.stack([t.to_class for t in tables])


def _from_utf8(model: Model, text: str, lo: int, hi: int, readers: list[_Utf8In]) -> tuple[str, float]:
    """Best reading of text[lo:hi] as UTF-8 in some page, with its gain in nats."""
    run, before, after = text[lo:hi], text[max(lo - 1, 0):lo], text[hi:hi + 1]
    best, gain, was = run, 0.0, None
    for reader in readers:
        hits = bad = 0

        def put(m: re.Match) -> str:
            nonlocal hits, bad
            out = reader.decode(m.group())
            if out is None or not (out.isprintable() or out in "\xa0\xad\u200b\u200c\u200d\u2009\u202f\u3000\ufeff\x80\x81" or "\x80" <= out <= "\x9f"):
                return m.group()
            hits += 1
            bad += model.seen[classes(_codes(out))[0]] < 2e-7
            return out

        out = reader.find.sub(put, run)
        if hits:
            was = model.text(before + run + after) if was is None else was
            # a valid sequence is itself unlikely by chance; one that gives a character unknown here is not
            g = model.text(before + out + after) - was + UTF8_BONUS * hits - 2 * UTF8_BONUS * bad
            if g > gain:
                best, gain = out, g
    return best, gain


def _from_single(model: Model, codes: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray | None, float]:
    """Best pair of one-byte pages over the improbable runs: the new code points and the gain."""
    low = _slots(codes)
    at = np.flatnonzero((codes > 0x7F) & (low != PUNCT1))
    run = np.searchsorted(starts, at, "right") - 1
    inside = (run >= 0) & (at < ends[run])
    at, run = at[inside], run[inside]
    if not len(at):
        return None, 0.0
    new = _SINGLE_TO[:, low[at]]  # all tables at once
    ch = new != codes[at]
    pairs = np.unique(np.concatenate([at[at > 0] - 1, at[at < len(codes) - 1]]))
    which = np.maximum(np.searchsorted(starts, pairs + 1, "right") - 1, 0)
    old_l, old_r = c[pairs], c[pairs + 1]
    # neighbours outside the runs are ASCII or beyond the tables, so the tables leave them as they are
    new_l, new_r = _SINGLE_CLASS[:, low[pairs]], _SINGLE_CLASS[:, low[pairs + 1]]
    d = model.score[np.where(new_l < 0, old_l, new_l), np.where(new_r < 0, old_r, new_r)] - model.score[old_l, old_r]
    ids, first = np.unique(run, return_index=True)
    changed = np.add.reduceat(ch, first, axis=1, dtype=np.int64)
    by_run = np.zeros((len(new), len(starts)))
    ids_p, first_p = np.unique(which, return_index=True)
    by_run[:, ids_p] = np.add.reduceat(d, first_p, axis=1)
    by_run = by_run[:, ids]
    good = (changed > 0) & (by_run > PER_CHARACTER * changed)
    gains = np.where(good, by_run, 0.0).sum(1)
    k = int(gains.argmax())
    if gains[k] <= 0:
        return None, 0.0
    keep = good[k][np.searchsorted(ids, run)] & ch[k]
    out = codes.copy()
    out[at[keep]] = new[k][keep]
    return out, float(gains[k])


def _may_gain(model: Model, codes: np.ndarray, c: np.ndarray) -> bool:
    """Whether any table could gain enough on any choice of runs: a bound over whole non-ASCII stretches.

    Runs hold whole stretches, so what a run gains is a sum over its stretches; a stretch that loses
    lowers it. Where this says no, no run needs to be isolated.
    """
    low = _slots(codes)
    at = np.flatnonzero((codes > 0x7F) & (low != PUNCT1))
    if not len(at):
        return False
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    n = len(codes)
    right = np.minimum(at + 1, n - 1)
    left = np.maximum(at - 1, 0)
    here, after, before = c[at], c[right], c[left]
    new, new_after, new_before = _SINGLE_CLASS[:, low[at]], _SINGLE_CLASS[:, low[right]], _SINGLE_CLASS[:, low[left]]
    new_after, new_before = np.where(new_after < 0, after, new_after), np.where(new_before < 0, before, new_before)
    d = (model.score[new, new_after] - model.score[here, after]) * (right > at)
    head = np.zeros(len(at), bool)
    head[first] = True
    d = d + np.where(head & (left < at), model.score[new_before, new] - model.score[before, here], 0)
    gain = np.add.reduceat(d, first, axis=1)
    changed = np.add.reduceat(new != here, first, axis=1, dtype=np.int64)
    return bool(((np.maximum(gain, 0).sum(1) > SINGLE_MARGIN) & ((gain > PER_CHARACTER * changed) & (changed > 0)).any(1)).any())


def _asian_readings(model: Model, run: str) -> list[tuple[str, float] | None]:
    """For each East Asian pair of pages, what a run of characters gives with the nats gained, or None."""
    hit = model.readings.get(run)
    if hit is None:
        hit, raw = [], {}
        was = model.text(run)
        for read, written in EAST_ASIAN:
            try:
                if read not in raw:
                    raw[read] = None
                    raw[read] = run.translate(_TO_BYTES[read]).encode("latin-1")
                out = raw[read].decode(written) if raw[read] is not None else run
            except (UnicodeDecodeError, UnicodeEncodeError):
                out = run
            step = 0.0 if out == run or _CANNOT.search(out) else model.text(out) - was * len(out) / len(run)
            hit.append((out, step) if step > 0.5 * len(out) else None)
        if len(model.readings) > 200_000:
            model.readings.clear()
        model.readings[run] = hit
    return hit


def _multibyte(model: Model, text: str, wide: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[str, float]:
    """Runs of a one-byte page that are valid text of an East Asian one."""
    many = np.concatenate([[0], np.cumsum(wide)])
    enough = many[ends] - many[starts] >= 0.4 * (ends - starts)
    runs = [(s, e, _asian_readings(model, text[s:e])) for s, e in zip(starts[enough].tolist(), ends[enough].tolist())]
    best, gain = text, 0.0
    for k in range(len(EAST_ASIAN)):
        g = sum(r[k][1] for _, _, r in runs if r[k])
        if g > gain:
            pieces, last = [], 0
            for s, e, r in runs:
                if r[k]:
                    pieces += [text[last:s], r[k][0]]
                    last = e
            best, gain = "".join(pieces) + text[last:], g
    return best, gain


def _runs(v: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Improbable runs of characters that hold a non-ASCII one, grown to whole non-ASCII stretches."""
    seg = maximal_segments(v)
    if not seg:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s, e = np.array(seg, np.int64).T
    e = e + 1  # pairs to characters
    n = len(wide)
    index = np.arange(n)
    first = np.maximum.accumulate(np.where(wide, -1, index)) + 1  # start of the stretch an index stands in
    last = np.minimum.accumulate(np.where(wide, n, index)[::-1])[::-1]
    s = np.where((s > 0) & wide[np.maximum(s - 1, 0)], first[np.maximum(s - 1, 0)], s)
    e = np.where((e < n) & wide[np.minimum(e, n - 1)], last[np.minimum(e, n - 1)], e)
    many = np.concatenate([[0], np.cumsum(wide)])
    keep = many[e] > many[s]
    s, e = s[keep], e[keep]
    if len(s) > 1:
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order])
        head = np.concatenate([[True], s[1:] > e[:-1]])
        e = np.maximum.reduceat(e, np.flatnonzero(head))
        s = s[head]
    return s, e


def restore(model: Model, text: str | None) -> tuple[bool, str | None, float]:
    """(found by a mapping, restored text, nats gained) of one text."""
    if not text or text.isascii():
        return False, text, 0.0
    if not _UTF8:
        _setup()
    total, found = 0.0, False
    while True:  # text may be garbled more than once; each round that goes on shortens it
        codes = _codes(text)
        c = classes(codes)
        wide = codes > 0x7F
        low = np.minimum(codes, PUNCT1)
        side = np.flatnonzero(wide[:-1] & wide[1:])
        a, b = low[side], low[side + 1]
        readers = [r for r in _UTF8 if (r.lead[a] & r.cont[b]).any()] if len(side) else []
        single = not found and _may_gain(model, codes, c)
        # a pair gains less than ASIAN_MARGIN, so two pairs of bytes are needed
        asian = int(np.count_nonzero(_IN_ASIAN[a] & _IN_ASIAN[b])) > 1 if len(side) else False
        if not readers and not single and not asian:
            break
        s, e = _runs(np.clip(-model.score[c[:-1], c[1:]], -2.5, 4.0), wide)
        if not len(s):
            break
        pieces, end, gained = [], 0, 0.0
        if readers:
            for i, j in zip(s.tolist(), e.tolist()):
                out, g = _from_utf8(model, text, i, j, readers)
                if g > MARGIN:
                    pieces += [text[end:i], out]
                    end, gained = j, gained + g
        if gained:
            text, total, found = "".join(pieces) + text[end:], total + gained, True
            continue
        out, g = _from_single(model, codes, c, s, e) if single else (None, 0.0)
        if asian:
            other, g2 = _multibyte(model, text, wide, s, e)
            if g2 > max(g, ASIAN_MARGIN):
                text, total, found, g = other, total + g2, True, 0.0
        if out is not None and g > SINGLE_MARGIN:
            text, total, found = out.tobytes().decode("utf-32-le", "surrogatepass"), total + g, True
        break
    return found, text, total


def damaged(c: Column) -> Column:
    """Whether a text holds lost characters: replacement characters, or control codes other than the line break U+0085."""
    return c.rlike("[\\uFFFD\\x80-\\x84\\x86-\\x9F]")


_MODELS: dict[str, Model] = {}


def repaired(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, affected, how, restored, gain) of every text that isn't plain ASCII.

    Two passes over the table: the pair counts (one small shuffle) and a map without a shuffle.
    """
    counts = pair_counts(df, text_col).toPandas()  # at most ALPHABET squared rows
    pair, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    key = uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast((pair, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(*sent.value)
        model = _MODELS[key]
        for b in batches:
            rows = [restore(model, t) for t in b.column(1).to_pylist()]
            a, t, g = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.bool_()), b.column(2), pa.array(t, pa.string()), pa.array(g, pa.float64())], [id_col, "found", "lost", "restored", "gain"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(id_col, text_col, damaged(F.col(text_col)).alias("lost")).where(F.col(text_col).rlike(r"[^\x00-\x7F]")).mapInArrow(run, f"`{id_col}` {kind}, found boolean, lost boolean, restored string, gain double")
    how = F.when(F.col("found"), "mapping").when(F.col("lost"), "damage")
    return out.select(id_col, how.isNotNull().alias("affected"), how.alias("how"), "restored", "gain")
