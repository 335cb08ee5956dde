"""Personal information inside free text: a linear-chain conditional random field.

Tokens are runs of letters or digits and single marks. The field's features are a token's own shape, affixes and
words, how common it is in a public tokenizer's vocabulary, and the same of its neighbours; its weights are fitted by
L-BFGS on a small labelled table. Decoding is Viterbi in numpy over batches of many sentences. Sentences are passed over
only where a bound proves that Viterbi would label every token O. Exact checks then set a found span's
edges (a number's plus sign, a mail name's first character) and drop spans that cannot be of their kind.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.addresses import DIRECTION_OF, HARD_TYPES, TYPE_OF
from placeloom.llm.entity_match import KINDS as VENUE_KINDS
from placeloom.llm.pii_labels import DIGIT_WORDS, KINDS, labelled

LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
TOKEN = re.compile(r"(?:[^\W\d_]+|\d+|[^\s])\s*|\s+")
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "lady", "captain", "officer", "chef", "sr", "sra", "señor", "señora", "madame", "monsieur", "mme", "herr", "frau", "don", "doña"}
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters decoded at a time; a longer text is cut at a line's end, else at a sentence's, else at a space.
BLOCK = 1_000_000
PAD = "\n\n"
OFFSETS = (0, -1, 1, -2, 2)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Tokens of a public tokenizer (tiktoken form) and their ranks; commoner words have smaller ones."""
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(n) for k, n in (line.split() for line in f if line.strip())}


def parts(low: str, vocab: dict[bytes, int]) -> int:
    """Into how few vocabulary entries the word falls when the longest is taken first, up to 4."""
    left, n = f" {low}".encode(), 0
    while left and n < 4:
        k = next((k for k in range(min(len(left), 16), 1, -1) if left[:k] in vocab), 1)
        left, n = left[k:], n + 1
    return n


def own_features(tok: str, near: bool, vocab: dict[bytes, int]) -> list[str]:
    """Features of one token (with its trailing space); ``near`` leaves out the rare ones, for neighbours."""
    w = tok.strip()
    tail = "line" if "\n" in tok else "gap" if tok != tok.rstrip() else "glued"
    if not w:
        return ["pad", tail]
    low = w.lower()
    if w.isdigit():
        f = [f"d{min(len(w), 10)}"]
    elif w.isalpha():
        shape = "X" if len(w) == 1 and w.isupper() else "x1" if len(w) == 1 else "XX" if w.isupper() else "Xx" if w[0].isupper() else "x"
        # a word that stands in the vocabulary in small letters is common; one only with a capital is a name
        common, named = vocab.get(f" {low}".encode()), vocab.get(f" {low.capitalize()}".encode())
        how = "c" if common is not None and common < 20_000 else "r" if common is not None else "n" if named is not None else "u"
        f = [shape, "w=" + low, f"{shape}{how}", how, f"{shape}{how}{parts(low, vocab)}"]
        if not near:
            f += ["p3=" + low[:3], "s3=" + low[-3:], f"len{min(len(low), 12) // 3}"]
        if len(low) >= 4:
            f += ["s4=" + low[-4:], "s6=" + low[-6:]]
        if low in TYPE_OF and TYPE_OF[low] in HARD_TYPES:
            f.append("street type")
        if low in DIRECTION_OF:
            f.append("direction")
        if low in DIGIT_WORDS:
            f.append("digit word")
        if low in VENUE_KINDS:
            f.append("venue kind")
        if low in TITLES:
            f.append("title")
    else:
        f = ["m=" + w]
    return f + [tail, f[0] + tail]


def token_key(tok: str) -> str:
    """Numbers of one length are one token."""
    w = tok.strip()
    return "7" * min(len(w), 10) + tok[len(w) :][:1] if w.isdigit() else tok


def boundary_flags(tok: str) -> tuple[bool, bool, bool, bool]:
    """Ends a line; is a stop with space after it; may stand before a stop; may begin a sentence."""
    w = tok.strip()
    return "\n" in tok or not w, w in (".", "!", "?", "…") and tok != w, w.isdigit() or len(w) >= 4, bool(w) and not w[0].isdigit() and not w[0].islower()


def cuts(line, stop, long, opens):
    """Where sentences end: at a line's end, or at a stop after a longer word and before a capital or mark."""
    return line | (stop & np.concatenate([[False], long[:-1]]) & np.concatenate([opens[1:], [True]]))


class Tagger:
    """Weights of the field and its decoder. Emissions and transitions are kept relative to O."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, path: str = VOCABULARY):
        self.index, self.weights, self.trans, self.start, self.path = index, weights, trans, start, path
        self.begin()
        # the most that a path can gain over O by entering, staying in and leaving a kind, from whatever label
        t, first = trans - trans[0, 0], start - start[0]
        kinds = range(1, len(LABELS), 2)
        self.enter = np.array([max(t[:, k].max(), first[k]) for k in kinds])
        self.stay = np.array([t[[k, k + 1], k + 1].max() for k in kinds])
        self.leave = np.array([max(0.0, t[k, 0], t[k + 1, 0]) for k in kinds])

    def begin(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.tables = np.zeros((len(OFFSETS), 4096, len(LABELS)), np.float32)
        self.tops = np.zeros((len(OFFSETS), 4096), np.float32)
        self.flags = np.zeros((4096, 4), bool)
        self.pad = self.number(PAD)

    def __getstate__(self):
        return self.index, self.weights, self.trans, self.start, self.path

    def __setstate__(self, state):
        self.__init__(*state)

    def number(self, tok: str) -> int:
        """A row number for the token; its emissions at each offset are summed once."""
        key = token_key(tok)
        k = self.known.get(key)
        if k is None:
            k = self.used
            self.used += 1
            if k == len(self.flags):
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
                self.tops = np.concatenate([self.tops, np.zeros_like(self.tops)], axis=1)
                self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
            vocab = vocabulary(self.path)
            near, own = own_features(key, True, vocab), own_features(key, False, vocab)
            for t, o in enumerate(OFFSETS):
                ids = [i for f in (near if o else own) if (i := self.index.get(f"{o}{f}")) is not None]
                if ids:
                    e = self.weights[ids].sum(axis=0)
                    self.tables[t, k] = e - e[0]
                self.tops[t, k] = self.tables[t, k, 1:].max()
            self.flags[k] = boundary_flags(tok)
            self.known[key] = k
        if key is not tok:
            self.known[tok] = k
        return k

    def spans(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) in characters, for each text; texts may be null or empty."""
        result: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        block: list[tuple[int, int, str]] = []
        size = 0
        for d, t in enumerate(texts):  # blocks of bounded size
            at, t = 0, t or ""
            while at < len(t):
                end = len(t)
                if end - at > BLOCK:
                    ends = (t.rfind(mark, at + BLOCK // 2, at + BLOCK) + len(mark) for mark in ("\n", ". ", " "))
                    end = next((z for z in ends if z > at + BLOCK // 2), at + BLOCK)
                block.append((d, at, t[at:end]))
                size += end - at
                at = end
                if size > BLOCK:
                    self._spans(block, texts, result)
                    block, size = [], 0
        if block:
            self._spans(block, texts, result)
        return [sorted(r) for r in result]

    def _spans(self, block: list[tuple[int, int, str]], texts: Sequence[str | None], result: list[list[tuple[int, int, str]]]) -> None:
        """Adds the spans of the pieces (text, offset, piece) of ``block`` to ``result``."""
        if self.used > 200_000 or len(self.known) > 400_000:  # bounded memory: begin anew, between blocks only
            self.begin()
        get, number = self.known.get, self.number
        ids: list[int] = [self.pad]
        chars: list[np.ndarray] = [np.zeros(1, np.int64)]
        doc: list[np.ndarray] = [np.full(1, -1)]
        for d, off, t in block:
            toks = TOKEN.findall(t)
            ids += [k if (k := get(x)) is not None else number(x) for x in toks]
            ids.append(self.pad)
            n = np.fromiter(map(len, toks), np.int64, len(toks))
            chars += [np.cumsum(n) - n + off, np.full(1, off + len(t))]
            doc += [np.full(len(toks), d), np.full(1, -1)]
        x, at, own = np.array(ids), np.concatenate(chars), np.concatenate(doc)
        fl = self.flags[x]
        edge = np.append(own[1:] < 0, True)  # texts end, padding stands alone
        starts = np.flatnonzero(np.concatenate([[True], (edge | cuts(fl[:, 0], fl[:, 1], fl[:, 2], fl[:, 3]))[:-1]]))
        stops = np.append(starts[1:], len(x))
        keep = np.flatnonzero(self.may_hold(x, starts, stops))
        first, last = starts[keep], stops[keep]
        size = last - first
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):
            top = size[order[a]]
            b = int(np.searchsorted(size[order], max(top + 4, int(top * 1.25)), side="right"))
            b = min(b, a + max(1, min(4000, 400_000 // max(1, int(top)))))
            rows = order[a:b]
            labels, mask, cell = self.viterbi(x, first[rows], size[rows])
            self.collect(labels, mask, cell, x, at, own, texts, result)
            a = b

    def near_rows(self, x: np.ndarray, of: np.ndarray, o: int) -> np.ndarray:
        """The token ``o`` places on, padding where that is another sentence (``of`` numbers the sentences)."""
        out = np.full(len(x), self.pad, x.dtype)
        a, b = (slice(None, -o), slice(o, None)) if o > 0 else (slice(-o, None), slice(None, o))
        out[a] = np.where(of[a] == of[b], x[b], self.pad)
        return out

    def may_hold(self, x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each sentence, False only if the best path is certainly O throughout.

        A path gains over O the sum of its spans' gains, and a span of a kind gains at most its entry, its tokens' emissions
        over O, its steps inside and its exit. Where no span of any kind can gain, no path can.
        """
        of = np.repeat(np.arange(len(starts)), stops - starts)
        rows = {o: self.near_rows(x, of, o) for o in OFFSETS[1:]}
        most = self.tops[0][x]
        for t, o in enumerate(OFFSETS[1:], 1):
            most += self.tops[t][rows[o]]
        # a looser bound first: some token must gain by some label
        some = np.maximum.reduceat(most, starts) + max(self.enter.max(), self.stay.max()) + self.leave.max() > 0
        at = np.flatnonzero(some[of])
        if not len(at):
            return some
        e = self.tables[0][x[at]]
        for t, o in enumerate(OFFSETS[1:], 1):
            e += self.tables[t][rows[o][at]]
        sub = of[at]
        heads = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        gain = np.zeros(len(heads), bool)
        for k in range(len(KINDS)):
            inner = e[:, 2 + 2 * k].astype(np.float64) + self.stay[k]
            inner[heads] = -1e4  # nothing goes on from the sentence before
            run = np.cumsum(inner)
            best = run + np.maximum.accumulate(e[:, 1 + 2 * k] + self.enter[k] - run)
            gain |= np.maximum.reduceat(best, heads) + self.leave[k] > -1e-3
        out = np.zeros(len(starts), bool)
        out[sub[heads]] = gain
        return out

    def viterbi(self, x: np.ndarray, first: np.ndarray, size: np.ndarray):
        n, most = len(first), int(size.max())
        cell = np.minimum(first[:, None] + np.arange(most), len(x) - 1)
        mask = np.arange(most) < size[:, None]
        here = np.where(mask, x[cell], self.pad)
        e = self.tables[0][here]
        wide = np.pad(here, ((0, 0), (2, 2)), constant_values=self.pad)  # a sentence sees nothing of its neighbours
        for t, o in enumerate(OFFSETS[1:], 1):
            e += self.tables[t][wide[:, 2 + o : 2 + o + most]]
        e = np.ascontiguousarray(e.transpose(1, 2, 0))  # step, label, sentence: every operation runs over sentences
        trans, on = self.trans.astype(np.float32), np.ascontiguousarray(mask.T)
        score = np.empty_like(e)
        score[0] = e[0] + self.start.astype(np.float32)[:, None]
        for k in range(1, most):
            old = score[k - 1]
            new = old[0] + trans[0][:, None]
            for p in range(1, len(LABELS)):
                np.maximum(new, old[p] + trans[p][:, None], out=new)
            score[k] = np.where(on[k], new + e[k], old)
        labels = np.zeros((n, most), np.int8)
        y = score[most - 1].argmax(axis=0)
        for k in range(most - 1, -1, -1):
            labels[:, k] = y
            if k:  # the best way into y is found again, only where it is needed
                y = np.where(on[k], (score[k - 1] + trans[:, y]).argmax(axis=0), y)
        return np.where(mask, labels, 0), mask, cell

    def collect(self, labels, mask, cell, x, at, own, texts, result) -> None:
        rows, cols = np.nonzero(labels % 2 == 1)  # B labels are odd
        for r, c in zip(rows.tolist(), cols.tolist()):
            k = int(labels[r, c])
            end = c + 1
            while end < labels.shape[1] and labels[r, end] == k + 1:
                end += 1
            a, z = cell[r, c], cell[r, end - 1]
            d = int(own[a])
            if d < 0 or int(own[z]) != d:
                continue
            t = texts[d]
            stop = int(at[z + 1])
            stop = int(at[a]) + len(t[int(at[a]) : stop].rstrip())
            s = settle(t, int(at[a]), stop, KINDS[(k - 1) // 2])
            if s and not (result[d] and s[0] < result[d][-1][1] and s[1] > result[d][-1][0]):
                result[d].append(s)


def settle(t: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The span with its exact edges, or None where its text cannot be of its kind."""
    if kind == "email":
        local = re.search(r"[\w.+%-]*$", t[max(0, a - 80) : a])
        lead = local.group() if local else ""
        a -= len(lead)
        end = re.match(r"[\w.-]*\w", t[b : b + 80]) if b < len(t) and t[b - 1] not in " \n" else None
        b += end.end() if end else 0
        m = re.match(r"(?i)mailto:|contact=", t[a:b])
        a += m.end() if m else 0
        while a < b and not (t[a].isalnum() or t[a] in "_+"):
            a += 1
        b -= len(t[a:b]) - len(t[a:b].rstrip(".-,;:)>]}\"'"))
        return (a, b, kind) if re.search(r"(?i)[@＠]|\bat\b", t[a:b]) else None
    if kind == "phone":
        while a > 0 and t[a - 1] in "+(":
            a -= 1
        m = re.match(r"[^\w+(]+", t[a:b])
        a += m.end() if m else 0
        digits = sum(c.isdigit() for c in t[a:b]) + sum(w in DIGIT_WORDS for w in re.findall(r"[a-z]+", t[a:b].lower()))
        return (a, b, kind) if digits >= 7 else None
    if kind == "id_number":
        m = re.match(r"\W+", t[a:b])
        a += m.end() if m else 0
        m = re.search(r"(?:^|[^\w])([A-Z]{1,2}[ -]?)$", t[max(0, a - 5) : a])
        a -= len(m.group(1)) if m else 0
        return (a, b, kind) if sum(c.isdigit() for c in t[a:b]) >= 5 else None
    if kind == "street_address":
        m = re.match(r"\W+", t[a:b])
        a += m.end() if m else 0
        while a > 0 and t[a - 1].isdigit() and t[a].isdigit():
            a -= 1
        if re.search(r'[{}"|<>]', t[a:b]) or t[a - 1 : a] == "#":
            return None
        return (a, b, kind) if re.search(r"\d", t[a:b]) and re.search(r"[^\W\d_]{3}", t[a:b]) else None
    while True:
        m = re.match(r"\W+|_+", t[a:b]) or re.match(r"([^\W\d_]+)\.?\s+", t[a:b])
        if not m or (m.lastindex and m.group(1).lower() not in TITLES):
            break
        a += m.end()
    words = re.findall(r"[^\W\d_]+", t[a:b])
    return (a, b, kind) if len(words) >= 2 and max(map(len, words)) >= 3 else None


def encode(rows: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[list[list[str]], list[list[int]]]:
    """Tokens and labels of labelled texts, cut into sentences as in decoding."""
    toks, labels = [], []
    for text, spans in rows:
        ts = TOKEN.findall(text)
        at, ys = 0, []
        for x in ts:
            y = 0
            for a, b, kind in spans:
                if a <= at < b:
                    y = 1 + 2 * KINDS.index(kind) + (at > a)
            ys.append(y)
            at += len(x)
        ends = cuts(*np.array([boundary_flags(x) for x in ts]).T)
        a = 0
        for b in [*(np.flatnonzero(ends) + 1).tolist(), len(ts)]:
            if b > a:
                part = ys[a:b]
                for i, y in enumerate(part):  # what is left of a span that the cut divides
                    if y and y % 2 == 0 and (i == 0 or part[i - 1] not in (y, y - 1)):
                        part[i] = 0
                toks.append(ts[a:b])
                labels.append(part)
            a = b
    return toks, labels


@lru_cache(maxsize=1)
def train(rows: int = 12000, iterations: int = 110, l2: float = 0.15, path: str = VOCABULARY) -> Tagger:
    """Fit the field on the labelled table by L-BFGS; takes some seconds and the same path each time."""
    toks, labels = encode(labelled(rows))
    vocab = vocabulary(path)
    kinds: dict[str, int] = {PAD: 0}
    flat = [kinds.setdefault(token_key(x), len(kinds)) for s in toks for x in [PAD, PAD, *s, PAD, PAD]]
    padded = np.array(flat)
    inside = np.concatenate([np.concatenate([[False] * 2, np.ones(len(s), bool), [False] * 2]) for s in toks])
    where = np.flatnonzero(inside)
    n = len(where)
    place = {o: padded[where + o] for o in OFFSETS}
    seen = np.bincount(place[0], minlength=len(kinds))
    # features of each distinct token; those that occur once say nothing
    of = {near: [own_features(k, near, vocab) for k in kinds] for near in (False, True)}
    index: dict[str, int] = {}
    pair_kind, pair_feat = {}, {}
    for o in OFFSETS:
        often: dict[str, int] = {}
        for k, fs in enumerate(of[o != 0]):
            for f in fs:
                often[f] = often.get(f, 0) + int(seen[k])
        ps = [(k, index.setdefault(f"{o}{f}", len(index))) for k, fs in enumerate(of[o != 0]) for f in fs if often[f] > 1 or k == 0]
        pair_kind[o], pair_feat[o] = (np.array(c) for c in zip(*ps))
    L = len(LABELS)
    y = np.array([v for ys in labels for v in ys])
    size = np.array([len(t) for t in toks])
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")  # longest first: at step k the first active[k] sentences go on
    size, first = size[order], first[order]
    active = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size[0]))]
    gold = np.zeros((n, L))
    gold[np.arange(n), y] = 1
    gold_trans = np.zeros((L, L))
    for k, m in enumerate(active[1:], 1):
        np.add.at(gold_trans, (y[first[:m] + k - 1], y[first[:m] + k]), 1)
    gold_start = np.bincount(y[first], minlength=L).astype(float)
    banned = np.zeros((L, L), bool)  # I follows only its own B or I
    for k in range(len(KINDS)):
        banned[:, 2 + 2 * k] = True
        banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    banned_start = np.array([i > 0 and i % 2 == 0 for i in range(L)])
    nw = len(index) * L

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, trans, start = theta[:nw].reshape(-1, L), np.where(banned, -30.0, theta[nw : nw + L * L].reshape(L, L)), np.where(banned_start, -30.0, theta[nw + L * L :])
        e = np.zeros((n, L))
        for o in OFFSETS:
            table = np.zeros((len(kinds), L))
            for j in range(L):
                table[:, j] = np.bincount(pair_kind[o], w[pair_feat[o], j], len(kinds))
            e += table[place[o]]
        T = np.exp(trans)
        p = e[first] + start
        top = p.max(axis=1)
        p = np.exp(p - top[:, None])
        total = p.sum(axis=1)
        alpha, logz = [p / total[:, None]], np.log(total).sum() + top.sum()
        for k, m in enumerate(active[1:], 1):
            ek = e[first[:m] + k]
            top = ek.max(axis=1)
            p = (alpha[-1][:m] @ T) * np.exp(ek - top[:, None])
            total = p.sum(axis=1)
            alpha.append(p / total[:, None])
            logz += np.log(total).sum() + top.sum()
        beta = np.ones((len(size), L))
        post = np.zeros((n, L))
        exp_trans = np.zeros((L, L))
        for k in range(len(active) - 1, -1, -1):
            m = active[k]
            g = alpha[k] * beta[:m]
            g /= g.sum(axis=1, keepdims=True)
            post[first[:m] + k] = g
            if k == 0:
                exp_start = g.sum(axis=0)
                break
            ek = e[first[:m] + k]
            b = np.exp(ek - ek.max(axis=1, keepdims=True)) * beta[:m]
            before = alpha[k - 1][:m]
            r = 1 / np.maximum(((before @ T) * b).sum(axis=1), 1e-300)
            exp_trans += T * ((before * r[:, None]).T @ b)
            nb = b @ T.T
            beta[:m] = nb / nb.max(axis=1, keepdims=True)
        score = (e * gold).sum() + (trans * gold_trans).sum() + (start * gold_start).sum()
        grad_w, off = np.zeros_like(w), post - gold
        for o in OFFSETS:
            for j in range(L):
                grad_w[:, j] += np.bincount(pair_feat[o], np.bincount(place[o], off[:, j], len(kinds))[pair_kind[o]], len(index))
        grad = np.concatenate([grad_w.ravel(), np.where(banned, 0, exp_trans - gold_trans).ravel(), np.where(banned_start, 0, exp_start - gold_start)])
        return logz - score + 0.5 * l2 * (theta @ theta), grad + l2 * theta

    theta = lbfgs(loss, np.zeros(nw + L * L + L), iterations)
    return Tagger(index, theta[:nw].reshape(-1, L).astype(np.float32), np.where(banned, -1e4, theta[nw : nw + L * L].reshape(L, L)), np.where(banned_start, -1e4, theta[nw + L * L :]), path)


def lbfgs(f, x: np.ndarray, iterations: int, memory: int = 7) -> np.ndarray:
    """Minimise ``f`` (value and gradient) from ``x``: limited-memory BFGS with backtracking."""
    fx, g = f(x)
    hist: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        d, coef = -g, []
        for s, v, rho in reversed(hist):
            a = rho * (s @ d)
            coef.append(a)
            d = d - a * v
        if hist:
            s, v, _rho = hist[-1]
            d = d * ((s @ v) / (v @ v))
        else:
            d = d / max(1.0, np.abs(g).max())
        for (s, v, rho), a in zip(hist, reversed(coef)):
            d = d + (a - rho * (v @ d)) * s
        slope, step = g @ d, 1.0
        if slope >= 0:
            break
        for _try in range(12):
            fn, gn = f(x + step * d)
            if fn <= fx + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, v = step * d, gn - g
        if s @ v > 1e-10:
            hist = [*hist[-(memory - 1) :], (s, v, 1 / (s @ v))]
        done = abs(fx - fn) < 1e-5 * max(1.0, abs(fn))
        x, fx, g = x + s, fn, gn
        if done:
            break
    return x


def redacted(text: str | None, spans: Sequence[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by [KIND]; the rest is unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def find(docs: DataFrame, doc_id: str, text: str, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos): every occurrence, positions in Unicode characters from 0.

    Null and empty texts hold nothing; rows without id are left out; repeated rows repeat their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            rows = [(d, kind, a, z) for d, sp in zip(b.doc_id, model.spans(list(b.t))) for a, z, kind in sp]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL AND t <> ''")
    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, kind string, start_pos long, end_pos long")


def redact(docs: DataFrame, text: str, into: str = "redacted", tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with the column ``into``: the text with a placeholder for each occurrence. Null stays null, empty stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for t in batches:
            t = t.astype(object).where(t.notna(), None)
            yield pd.Series([redacted(x, s) for x, s in zip(t, model.spans(list(t)))], dtype=object)

    return docs.withColumn(into, run(F.col(text)))
