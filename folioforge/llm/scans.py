"""Repair text from scanned pages (problem 1).

Method: skip-gram vectors (negative sampling) are learnt from the corpus' aggregated word pairs; the
objective depends on the pair counts only, so the learning step has a fixed size. A rare word gets a vector
too, the mean of the context vectors around its occurrences in a text. It is linked to those frequent words
that are its neighbours in the vector space and one or two plausible glyph edits away: the likelihood of its
similarity among words of one context, against that among words of different ones, is weighed with the
chance that a genuine word of its length lies so near a frequent one by accident. The best neighbour corrects
the word. A frequent word is a misreading of a far more frequent one, an edit away, where their mean contexts
agree. Then running headers and page numbers are removed, words broken at line ends are joined where the hyphen
isn't their own (corpus counts of the joined and the hyphenated form decide), and lines are reflowed.

A digit or sign within a word is a misreading whatever the word; where no frequent word is near (names), the
glyph whose letter pairs are the likeliest among the corpus' words replaces it.

Bounds: frequent words have at least ``WORD_SHARE`` of all words, so there are at most 1/WORD_SHARE;
learnt pairs have at least ``PAIR_SHARE`` of all pairs. Only those reach the driver and the workers, at most
100,000 words of 3 x 24 floats, about 30 MB; all counts run over all texts. No step groups rows by document.

Defined results: null stays null, empty stays empty; a text without scan noise only has its lines
reflowed and isn't affected; a paper without a title has no running header to be known by. A number in
brackets on a line of its own is a page number where it is as far from the row's page as the paper's other
page numbers are, else a label.
"""
from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialize

WORD_SHARE, PAIR_SHARE, LEAST = 1e-5, 5e-7, 5
DIM, WINDOW, NEGATIVE, EPOCHS = 24, 2, 5, 3
#: Words on each side that make a word's context.
AROUND = 4
#: Share of the rare words near a frequent one that are taken to be misread, before anything is known of them.
MISREAD = 0.05
#: A frequent word may be misread too, from one that is so many times as frequent.
RATIO = 8
#: Least cosine of the mean contexts of a frequent word and the one it is misread from.
SAME = 0.9
SALTS = 16
#: What a scan shows, and what may have been printed.
GLYPHS = (("c", "e"), ("@", "a"), ("+", "t"), ("!", "i"), ("!", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("$", "s"), ("€", "e"), ("£", "f"),
          ("cl", "d"), ("d", "cl"), ("q", "g"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("ſ", "f"), ("ſ", "s"), ("h", "ti"), ("h", "li"), ("vv", "w"),
          ("m", "in"), ("n", "ri"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("|", "l"), ("|", "i"), ("|", ""), ("^", ""), ("~", ""), ("’", ""), ("‘", ""), ("'", ""), ("`", ""),
          ("*", ""), ("·", ""), ("¦", ""), ("\\", ""), ("_", ""), ("°", "o"), ("µ", "u"), ("I", "l"), ("l", "I"))
_SYMBOL = re.compile(r"(?<=[^\W\d_])[@+!^~|ſ€£$\\*`¦](?=[^\W\d_])|(?<=[^\W\d_])[@+!^~|ſ¦](?=[^\W\d_]|$)|^[@+!^~|ſ](?=[^\W\d_]{2})")
_DIGIT = re.compile(r"(?<=[a-zà-ÿ])[0158](?=[a-zà-ÿ])|^[0158](?=[a-zà-ÿ]{3})|(?<=[a-zà-ÿ]{4})[0158]$")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:()[]?“”\"'«»„…"
#: A number in which a scan may have misread some digits as letters.
_NUMBER = r"(?=[lIOoSB]*\d)[\dlIOoSB]{1,4}"
_PAGE = re.compile(rf"^\W*(?:(?:p\s?a\s?g\s?e|p\.|pp\.|seite|s\.|página|pág\.)\s*)?(?:[-–—·•*|~]\s*)?({_NUMBER})(?:\s*[-–—·•*|~]+(?:\s*p\s?a\s?g\s?e)?)?(?:\s*(?:of|/|von|de|sur)\s*{_NUMBER})?\s*$", re.IGNORECASE)
#: What sets a running title off from the author, number or remark beside it.
_SET_OFF = re.compile(r"\s[—·/|]\s|[:,]\s|^\W*\d{1,4}\b|\b\d{1,4}\W*$")
_PAGE_BOX = re.compile(r"^\s*\[(\d{1,4})\]\s*$")
#: A line that holds a number only, whatever is around it.
PAGE_LINE = r"(?m)^[^\w\n]*([0-9]{1,4})[^\w\n]*$"
_BREAK = re.compile(r"([^\W\d_][\w’'-]*)([-¬­‐])[ \t]*\n[ \t]*([^\W_][\w’']*)(\S*)[ \t]*")
_HYPHEN_END = re.compile(r"[-¬­‐][ \t]*\n")
_NOT_ALNUM = re.compile(r"[^a-z0-9]+")
_BREAK_CJK = re.compile(r"([぀-ヿ一-鿿])[-¬­‐]\n(?=[぀-ヿ一-鿿])")


def _bare(token: str) -> str:
    """A token without the punctuation around it; an exclamation mark is one only behind a word."""
    return token.strip(_EDGE).rstrip("!" + _EDGE)


def words(text: str) -> list[str]:
    """Space-delimited words without the punctuation around them, hyphens inside kept; no numbers."""
    return [w for t in text.split() if (w := _bare(t)) and not w[0].isdigit()]


def _texts(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return chunks.select("text").unionByName(refs.select(F.col("raw").alias("text"))).where("text is not null")


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): lower-case words of all texts, counted per partition first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(words(t.lower()))
            if len(n) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])
                n = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    return texts.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(pair, n) of frequent words within the window of each other; pair = a * size + b."""
    size = len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inv, np.concatenate(ns)).astype(np.int64)

        for b in batches:
            ids: list[int] = []
            for t in b.column(0).to_pylist():
                ids += [vocab.get(w, -1) for w in words(t.lower())]
                ids += [-1] * WINDOW
            a = np.array(ids, np.int64)
            for k in range(1, WINDOW + 1):
                x, y = a[:-k], a[k:]
                ok = (x >= 0) & (y >= 0)
                p, n = np.unique(np.concatenate([x[ok] * size + y[ok], y[ok] * size + x[ok]]), return_counts=True)
                keys.append(p), ns.append(n)
                held += len(p)
            if held > 3_000_000:
                k, n = merged()
                keys, ns, held = [k], [n], len(k)
        if keys:
            k, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def skip_gram(pair: np.ndarray, n: np.ndarray, size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors by negative sampling over weighted pairs."""
    rng = np.random.default_rng(seed)
    u = ((rng.random((size, DIM)) - 0.5) / DIM).astype(np.float32)
    v = np.zeros((size, DIM), np.float32)
    if not len(pair):
        return u, v
    a, b = pair // size, pair % size
    freq = np.bincount(b, n, size) ** 0.75
    cdf = np.cumsum(freq / freq.sum())
    weight = np.minimum(n / n.mean(), 10.0) ** 0.5
    batch, rate = max(256, min(20_000, len(pair) // 20)), 0.5
    for epoch in range(EPOCHS):
        order = rng.permutation(len(pair))
        for s in range(0, len(order), batch):
            at = order[s:s + batch]
            i, j, w = a[at], b[at], weight[at].astype(np.float32)
            neg = np.minimum(np.searchsorted(cdf, rng.random((len(at), NEGATIVE))), size - 1)
            ui, vj, vn = u[i], v[j], v[neg]
            gp = (1 / (1 + np.exp(-np.clip((ui * vj).sum(1), -12, 12))) - 1) * w
            gn = (1 / (1 + np.exp(-np.clip(np.einsum("id,ind->in", ui, vn), -12, 12)))) * w[:, None] / NEGATIVE * 2
            du = gp[:, None] * vj + np.einsum("in,ind->id", gn, vn)
            r = rate * (1 - epoch / EPOCHS)
            for m, rows, g in ((u, i, du), (v, j, gp[:, None] * ui), (v, neg.ravel(), (gn[:, :, None] * ui[:, None, :]).reshape(-1, DIM))):
                hits = np.bincount(rows, minlength=size)
                total = np.stack([np.bincount(rows, g[:, d], size) for d in range(DIM)], 1)
                m -= (r * total / np.maximum(hits, 1)[:, None] ** 0.5).astype(np.float32)
    for m in (u, v):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    return u, v


def context_scores(pair: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    """Mean and deviation of the similarity of a word with a word of its own context, and with one of a foreign context.

    The first over all learnt pairs, the second over all words independently; both weighted by their counts.
    """
    size = len(u)
    if not len(pair):
        return (0.0, 1.0), (0.0, 1.0)
    a, b, w = pair // size, pair % size, n / n.sum()
    x = (u[a] * v[b]).sum(1).astype(np.float64)
    p, q = np.bincount(a, w, size), np.bincount(b, w, size)
    own, far = float(w @ x), float((p @ u) @ (q @ v))
    square = float(np.trace((u.T * p) @ u @ ((v.T * q) @ v)))
    return (own, max(float(w @ (x * x)) - own * own, 1e-4) ** 0.5), (far, max(square - far * far, 1e-4) ** 0.5)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9))


class Repairer:
    """Frequent words with their counts and vectors; corrects and cleans single texts."""

    def __init__(self, vocab: list[str], counts: list[int], u: np.ndarray, v: np.ndarray, own: tuple[float, float] = (0.0, 1.0), foreign: tuple[float, float] = (0.0, 1.0),
                 contexts: np.ndarray | None = None) -> None:
        self.id = {w: i for i, w in enumerate(vocab)}
        self.n = dict(zip(vocab, counts))
        self.u, self.v, self.own, self.foreign = u, v, own, foreign
        self.known: dict[str, dict[str, int]] = {}
        self.clean: set[str] = set()
        self.edits: dict[str, list[str]] = {}
        for a, b in GLYPHS:
            self.edits.setdefault(a, []).append(b)
        self.starts: dict[str, list[str]] = {}
        for a in self.edits:
            self.starts.setdefault(a[0], []).append(a)
        # how often a genuine word is one glyph edit from another frequent one, by length
        near, of, pairs = Counter(), Counter(), Counter()
        for w, n in self.n.items():
            k = min(len(w), 12)
            of[k] += 1
            near[k] += any(x != w and n < RATIO * self.n.get(x, 0) and self.n[x] < RATIO * n for x in self._once(w) if x in self.n)
            for x in zip("^" + w, w + "$"):
                pairs[x] += n
        self.accident = {k: (near[k] + 0.02) / (of[k] + 2.0) for k in range(1, 13)}
        total = sum(pairs.values()) or 1
        self.letters = {x: np.log((n + 0.1) / total) for x, n in pairs.items()}
        self.no_letters = float(np.log(0.1 / total))
        # words that are frequent only because a misreading is
        misread = {}
        for w, n in self.n.items():
            more = [x for x in self._once(w) if self.n.get(x, 0) >= RATIO * n and len(x) > 2 and not any(c.isdigit() for c in x)] if len(w) > 2 else []
            if more:
                sure = bool(_SYMBOL.search(w) or _DIGIT.search(w))
                misread[w] = max((self.odds(w, x, 1, sure, None) for x in more if sure or contexts is None or _cosine(contexts[self.id[w]], contexts[self.id[x]]) >= SAME), default=-9.0)
        self.misread = {w for w, o in misread.items() if o > 0}
        for w in self.misread:
            del self.n[w]

    def neighbours(self, w: str) -> dict[str, int]:
        """Frequent words one or two glyph edits away from a lower-case word, with the number of edits."""
        hit = self.known.get(w)
        if hit is None:
            if len(self.known) > 500_000:
                self.known.clear()
            one = self._once(w)
            good = lambda x: x in self.n and len(x) > 2 and not any(c.isdigit() for c in x)
            hit = {x: 1 for x in sorted(one) if good(x)}
            if not hit and (_SYMBOL.search(w) or _DIGIT.search(w)):
                hit = {x: 2 for y in sorted(one) for x in sorted(self._once(y)) if good(x)}
            self.known[w] = hit
        return hit

    def _once(self, w: str) -> set[str]:
        out = set()
        for i, c in enumerate(w):
            for a in self.starts.get(c, ()):
                if w.startswith(a, i):
                    for b in self.edits[a]:
                        out.add(w[:i] + b + w[i + len(a):])
        return out

    def context(self, around: list[str]) -> np.ndarray | None:
        """The context vectors around a rare word, whose mean is its own vector; None without a known word there."""
        ids = [i for x in around if (i := self.id.get(x)) is not None]
        return self.v[ids] if ids else None

    def odds(self, w: str, cand: str, edits: int, sure: bool, context: np.ndarray | None) -> float:
        """Log-odds that a rare word is a misreading of a frequent one."""
        accident = self.accident[min(len(w), 12)]
        out = np.log(MISREAD) - np.log(1e-4 if sure else min(1.0, accident * 30 ** (edits - 1)))
        if context is not None and cand in self.id:
            x = context @ self.u[self.id[cand]]
            log_p = lambda m, d: -0.5 * ((x - m) / d) ** 2 - np.log(d)
            out += (log_p(*self.own) - log_p(*self.foreign)).mean() * len(x) ** 0.5
        return float(out)

    def correct(self, w: str, context: np.ndarray | None) -> str | None:
        """The corrected word, or None where it isn't misread. ``context`` is its vector."""
        low = w.lower()
        if low in self.n or len(low) < 3:
            return None
        sure = bool(_SYMBOL.search(w) or _DIGIT.search(w))
        cands = self.neighbours(low)
        best = max(((self.odds(low, x, k, sure, context) + 0.05 * np.log(self.n[x]), x) for x, k in cands.items()), default=(-9.0, ""))
        if best[0] <= 0 and "-" in low.strip("-"):  # a part of a compound
            parts = low.split("-")
            fixed = [p if p in self.n or len(p) < 4 or not (o := max(((self.odds(p, x, k, sure, context), x) for x, k in self.neighbours(p).items()), default=(-9.0, "")))[0] > 0 else o[1] for p in parts]
            if fixed != parts and all(p in self.n for p in fixed):
                best = (1.0, "-".join(fixed))
        if best[0] > 0:
            return best[1].capitalize() if w[0].isupper() and not w[1:].isupper() else best[1].upper() if w.isupper() else best[1]
        if sure and sum(c.isalpha() for c in w) >= 4 and not re.search(r"[@/]\w+\.|https?:|\d{2}", w):
            return self.likeliest(w)
        return None

    def likeliest(self, w: str) -> str | None:
        """A word whose every digit or sign is replaced by the glyph with the likeliest letter pairs; None if one can't be."""
        out = w
        for i in range(len(w) - 1, -1, -1):
            if w[i].isalpha() and w[i] != "ſ" or w[i] in "-’'":
                continue
            options = [out[:i] + b + out[i + 1:] for b in self.edits.get(w[i], ())]
            if not options:
                return None
            out = max(options, key=lambda x: np.mean([self.letters.get(p, self.no_letters) for p in zip("^" + x.lower(), x.lower() + "$")]))
        return out if out != w else None

    def _passes(self, raw: str) -> bool:
        """Whether a token stays as it is in any context; such tokens are kept in a bounded set."""
        w = _bare(raw)
        low = w.lower()
        ok = len(w) < 3 or low in self.n or not w.isascii() and ord(w[0]) > 0x2E7F or not (
            self.neighbours(low) or _SYMBOL.search(w) or _DIGIT.search(w) or "-" in low.strip("-") and any(p not in self.n and len(p) > 3 and self.neighbours(p) for p in low.split("-")))
        if ok:
            if len(self.clean) > 1_000_000:
                self.clean.clear()
            self.clean.add(raw)
        return ok

    def broken(self, left: str, mark: str, right: str) -> bool:
        """Whether the hyphen between two parts at a line end isn't the word's own."""
        a, b = left.lower(), right.lower()
        tail = a.rsplit("-", 1)[-1]
        whole, own = self.n.get(tail + b, 0), max(self.n.get(f"{a}-{b}", 0), self.n.get(f"{tail}-{b}", 0))
        if whole or own:
            return whole >= own
        if right[0].isupper() and not left.isupper() or right[0].isdigit():
            return False
        if "-" in left:
            # a longer compound: its own hyphen goes on after the break
            return not (b in self.n and tail in self.n)
        return not (b in self.n and a in self.n and len(a) > 2 and len(b) > 2)

    def header(self, line: str, titles: tuple[str, ...]) -> bool:
        """Whether a line is a running header made of one of the titles' beginnings."""
        s = _squeeze(line)
        for t in titles:
            if len(t) < 6 or len(s) < 6:
                continue
            wide = ord(t[0]) > 0x2E7F
            step = 6 if wide else 12
            # the beginning, or, where it is misread, what follows it
            for start in (0, step) if len(t) >= 2 * step + 3 else (0,):
                at = s.find(t[start:start + step])
                if at < 0:
                    continue
                k = step
                while start + k < len(t) and at + k < len(s) and t[start + k] == s[at + k]:
                    k += 1
                if start:  # the misread beginning belongs to it
                    if at < start or sum(x == y for x, y in zip(t[:start], s[at - start:at])) < start // 2:
                        continue
                    k += start
                most = min(64, 2 * k) if k >= 22 and _SET_OFF.search(line) else min(48, k)
                if (k >= (7 if wide else 15) or k == len(t)) and len(s) - k <= max(12, most):
                    return True
        return False

    def furniture(self, line: str, titles: tuple[str, ...], page: int | None = None, offset: int | None = None) -> bool:
        if not line:
            return False
        if _PAGE.match(line):
            return True
        m = _PAGE_BOX.match(line)
        if m:
            return page is not None and offset is not None and int(m.group(1)) - page == offset
        return bool(titles) and self.header(line, titles)

    def repair(self, text: str | None, titles: tuple[str, ...], page: int | None = None, offset: int | None = None) -> tuple[bool, str | None]:
        """(affected, repaired text). ``offset`` is how far the paper's printed page numbers are from its pages."""
        if not text:
            return False, text
        affected = False
        kept = []
        lines = text.split("\n")
        for line in lines:
            if len(lines) > 1 and self.furniture(line, titles, page, offset):
                affected = True
            else:
                kept.append(line)
        text = "\n".join(kept)

        def join(m: re.Match) -> str:
            nonlocal affected
            if self.broken(m.group(1), m.group(2), m.group(3)):
                affected = True
                return f"{m.group(1)}{m.group(3)}{m.group(4)}\n"
            return f"{m.group(1)}-{m.group(3)}{m.group(4)}\n"

        if _HYPHEN_END.search(text):
            text = _BREAK.sub(lambda m: join(m), text)
            new = _BREAK_CJK.sub(r"\1", text)
            affected, text = affected or new != text, new
        clean = self.clean
        suspects = {t for t in text.split() if t not in clean and not self._passes(t)}
        if not suspects:
            return affected, reflow(text)
        tokens = list(_TOKEN.finditer(text))
        out, last = [], 0
        low = [_bare(t.group()).lower() for t in tokens]
        around: dict[str, list[str]] = {}
        for i, m in enumerate(tokens):  # all occurrences in the text make a rare word's vector
            if m.group() in suspects:
                around.setdefault(low[i], []).extend(low[max(0, i - AROUND):i] + low[i + 1:i + AROUND + 1])
        vectors = {w: self.context(x) for w, x in around.items()}
        for i, m in enumerate(tokens):
            raw = m.group()
            if raw not in suspects:
                continue
            w = _bare(raw)
            fixed = self.correct(w, vectors[low[i]])
            if fixed is not None and fixed != w:
                s = m.start() + raw.index(w)
                out += [text[last:s], fixed]
                last = s + len(w)
                affected = True
        text = "".join(out) + text[last:]
        return affected, reflow(text)


def reflow(text: str) -> str:
    """One line a paragraph; blank lines between paragraphs and list items stay."""
    paras = re.split(r"\n[ \t]*\n+", text)
    return "\n\n".join(re.sub(r"(?<=[぀-ヿ一-鿿。])\n(?=[぀-ヿ一-鿿])", "", p).replace("\n", " ").strip() if not re.search(r"^\s*(?:\d+[.)]|[-•*])\s", p, re.M) else p for p in paras)


class _Folds(dict):
    """Letters and digits of each character's decomposition, filled as characters are met."""

    def __missing__(self, cp: int) -> str:
        out = self[cp] = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if c.isalnum())
        return out


_FOLDS = _Folds()


def _squeeze(s: str) -> str:
    """Letters and digits only, folded."""
    s = s.lower()
    return _NOT_ALNUM.sub("", s) if s.isascii() else s.translate(_FOLDS)


_READY: dict[str, Repairer] = {}


def learn(chunks: DataFrame, refs: DataFrame) -> tuple:
    """Frequent words, their counts, word and context vectors, mean and deviation of their similarity with their own and a foreign context, their mean contexts.

    The sizes are bounded by the shares.
    """
    texts = _texts(chunks, refs)
    counts = materialize(word_counts(texts))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") >= max(LEAST, WORD_SHARE * total)).orderBy("w").toPandas()
    vocab = dict(zip(rows["w"], range(len(rows))))
    pairs = materialize(pair_counts(texts, vocab))
    all_pairs = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = pairs.where(F.col("n") >= max(2, PAIR_SHARE * all_pairs)).orderBy("pair").toPandas()
    u, v = skip_gram(p["pair"].to_numpy(np.int64), p["n"].to_numpy(np.float64), len(vocab))
    # the contexts of frequent words, from all their pairs
    pair, n = p["pair"].to_numpy(np.int64), p["n"].to_numpy(np.float64)
    a, size = pair // max(len(vocab), 1), len(vocab)
    contexts = np.stack([np.bincount(a, n * v[pair % max(size, 1), d], size) for d in range(DIM)], 1) / np.maximum(np.bincount(a, n, size), 1)[:, None]
    return list(vocab), rows["n"].tolist(), u, v, *context_scores(pair, n, u, v), contexts.astype(np.float32)


def page_offsets(rows: DataFrame) -> DataFrame:
    """(doc_hash, offset): how far most of a paper's printed page numbers are from its pages.

    At least two must agree; the corpus' usual offset, if most papers have it, holds for papers with fewer.
    """
    n = F.explode(F.regexp_extract_all("text", F.lit(PAGE_LINE), F.lit(1)))
    x = rows.where(F.col("page").isNotNull() & F.col("text").contains("\n")).select("doc_hash", "page", n.alias("n"))
    x = x.groupBy("doc_hash", (F.col("n").cast("int") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"))
    x = x.groupBy("doc_hash").agg(F.max_by("offset", F.struct("n", "offset")).alias("own"), F.max("n").alias("n"))
    x = materialize(x.select("doc_hash", F.when(F.col("n") >= 2, F.col("own")).alias("own")))
    usual = x.where("own is not null").groupBy("own").agg(F.count("*").alias("n")).agg(F.max_by("own", F.struct("n", "own")).alias("usual"), (F.max("n") * 2 > F.sum("n")).alias("most")).first()
    return x.select("doc_hash", F.coalesce("own", F.lit(usual.usual if usual.most else None).cast("int")).alias("offset"))


def repaired(chunks: DataFrame, refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(tab_name, row_id, affected, text) of all chunks and entries."""
    spark = chunks.sparkSession
    model = spark.sparkContext.broadcast(learn(chunks, refs))
    key = uuid.uuid4().hex
    page = lambda df: F.col("page").cast("int") if "page" in df.columns else F.lit(None).cast("int")
    rows = chunks.select(F.lit("chunks").alias("tab_name"), F.col("chunk_id").cast("bigint").alias("row_id"), "doc_hash", page(chunks).alias("page"), "text", "title").unionByName(
        refs.select(F.lit("extracted_refs").alias("tab_name"), F.col("ref_id").cast("bigint").alias("row_id"), "doc_hash", page(refs).alias("page"), F.col("raw").alias("text"), F.lit(None).cast("string").alias("title")))
    titles = manifest.where("title is not null").groupBy("doc_hash").agg(F.collect_set("title").alias("titles"))
    papers = titles.join(page_offsets(rows), "doc_hash", "full_outer")
    # only a text of several lines can hold furniture: the others don't meet their paper
    several = F.coalesce(F.col("text").contains("\n"), F.lit(False))
    # a paper with very many rows is spread over SALTS keys; titles are one short row a paper
    salted = rows.where(several).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    papers = papers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    cols = ["tab_name", "row_id", "text", "title", "titles", "page", "offset"]
    lined = salted.join(papers, ["doc_hash", "salt"], "left").select(*cols)
    plain = rows.where(~several).withColumn("titles", F.lit(None).cast("array<string>")).withColumn("offset", F.lit(None).cast("int")).select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Repairer(*model.value)
        r = _READY[key]
        squeezed: dict[str, str] = {}
        for b in batches:
            hit, out = [], []
            for text, title, titles, page, offset in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                own = tuple(squeezed.setdefault(t, _squeeze(t)) for t in {*(titles or ()), *([title] if title else ())})
                a, t = r.repair(text, own, page, offset)
                hit.append(a), out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.bool_()), pa.array(out, pa.string())], ["tab_name", "row_id", "affected", "text"])

    return lined.unionByName(plain).mapInArrow(run, "tab_name string, row_id bigint, affected boolean, text string")
