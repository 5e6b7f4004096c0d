"""Secret scans: pattern matches, and spans that a linear-chain conditional random field tags.

The field tags every token of the whole text ``O``, ``B`` or ``I`` (outside, at the beginning of or inside a
secret) from the token's shape, its neighbours, the word that introduces it (the nearest word before, over
at most ``GAP`` delimiters and words like "is") and two features of the whole file: how many marks of code
it has, and whether it ever names a secret. It is decoded by Viterbi. Any token may be tagged.

Decoding is exact and cheap on prose: a token whose ``O`` leads by more than any change of its neighbours'
tags could win back is ``O`` on every best path. The chain falls into runs between such tokens, and only
the runs are decoded. Long texts are read in blocks of ``BLOCK`` tokens that overlap by what features see.

Weights maximise the likelihood of a seeded set of written examples plus windows of about ``TRAIN_DOCS``
distinct documents at most (``WINDOWS`` of each at most, ``WIDTH`` tokens wide), whose pattern matches serve as
labels; windows with something that could be a secret without a match are left out. The field is
trained at each call: the examples are small.

Cases: a null text counts as empty and has no spans; an empty table gives an empty result and trains on
the examples alone; very long texts are tagged whole, in blocks; of equally good tags the first of O, B, I wins;
repeated rows are each scanned, but train once; ids may be null; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import string
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, fresh, read, slices

KINDS = ("assign", "access", "hex", "crf")
#: Documents and windows of each that train at most (about), tokens of a window.
TRAIN_DOCS, WINDOWS, WIDTH = 512, 16, 24
#: Passes over the training set, examples of a step, step size, L2 penalty.
EPOCHS, BATCH, STEP, L2 = 24, 128, 0.25, 1e-3
#: Tokens read at once; delimiters and copulas between a word and what it introduces at most.
BLOCK, GAP = 1 << 16, 6
#: Tokens, and characters of them, that a task remembers between blocks; beyond, it keeps those met most and learns others anew.
REMEMBERED, CHARACTERS = 1 << 17, 1 << 22

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DELIMITERS = r"\"'`,;:=()\[\]{}<>|"
#: A stretch of other characters, not ending in a full stop or the like; each delimiter is a token.
_TOKEN = re.compile(rf"[^\s{_DELIMITERS}.?!…]+(?:[.?!…]++[^\s{_DELIMITERS}.?!…]+)*+|\S")

# Words that announce a secret, words that may, and words between them and it.
_STRONG = frozenset("password passwd passphrase passcode pwd secret token apikey credential credentials bearer authorization".split())
_WEAK = frozenset("pass key private access auth signature pin login certificate".split())
_COPULAS = frozenset("is was are be as to the your my set new now = := -> =>".split())
_ENDS = ("password", "passwd", "passphrase", "secret", "token", "apikey")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "rk_", "xoxb", "xoxp", "eyJ", "AIza", "glpat", "npm_", "SG.", "MII")
TAGS = ("O", "B", "I")
_FORBIDDEN = -1e9

_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Kinds of neighbours and of tokens, and of what introduces a token.
NEAR = ("none", "strong", "weak", "copula", "assign", "quote", "delimiter", "number", "word", "code")
OWN = ("mark", "word", "long word", "mixed case", "number", "short code", "code", "long code", "symbols", "other")
HEADS = ("none", "strong assigned", "strong stated", "strong bare", "weak assigned", "weak stated", "weak bare")
OFFSETS = (-2, -1, 1, 2)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches that pass their length tests."""
    text = text or ""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class _Classes(dict):
    """Letters of what a character is: consonants and vowels by case, digits, other letters; marks stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = ("V" if c in "AEIOU" else "C") if "A" <= c <= "Z" else ("v" if c in "aeiou" else "c") if "a" <= c <= "z" else "9" if c.isdigit() else ("U" if c.isupper() else "u") if c.isalpha() else c
        self[code] = kind
        return kind


_CLASSES = _Classes()
_CONSONANTS, _CASED, _PLAIN = re.compile(r"[cC]+"), re.compile(r"[VCU]+|[vcu]+|9+|[^VCUvcu9]"), re.compile(r"[vcu]+|[VCU]?[vcu]*|[VCU]+")


def classes(token: str) -> str:
    return token.translate(_CLASSES)


def keyword(token: str) -> str:
    """strong, weak or an empty string: whether a part of the token names a secret."""
    low = token.lower()
    if low in _STRONG or low in _WEAK:
        return "strong" if low in _STRONG else "weak"
    if token.isalpha() and (low == token or low[1:] == token[1:]):
        return ""
    parts = {p.lower() for p in _PART.findall(token)}
    return "strong" if parts & _STRONG or {"api", "key"} <= parts or any(p.endswith(_ENDS) for p in parts) else "weak" if parts & _WEAK else ""


def near_kind(token: str, sig: str) -> str:
    digits = "9" in sig
    if not digits and (kind := keyword(token)):
        return kind
    if token.lower() in _COPULAS:
        return "copula"
    if len(token) == 1 and not token.isalnum():
        return "assign" if token in "=:" else "quote" if token in "\"'`" else "delimiter"
    return "number" if digits and not any(c in sig for c in "cCvVuU") else "code" if digits else "word"


def own_kind(sig: str) -> str:
    digits, n = sig.count("9"), len(sig)
    letters = sum(map(sig.count, "cCvVuU"))
    if not letters and not digits:
        return "mark"
    if letters + digits < n and any(c in sig for c in "@#$%^&*~"):
        return "symbols" if letters and digits else "other"
    if not digits:
        plain = letters < n or _PLAIN.fullmatch(sig) or "u" in sig or "U" in sig
        return ("long word" if n >= 14 else "word") if plain else "mixed case"
    if not letters:
        return "number"
    return "short code" if n < 8 else "code" if n < 20 else "long code"


def class_features(sig: str) -> tuple[str, ...]:
    """What a token's classes of characters say: always as many features."""
    n = len(sig)
    runs = _CASED.findall(sig)
    form = "".join("A" if r[0] in "VCU" else "a" if r[0] in "vcu" else r[0] for r in runs)
    digits, upper = sig.count("9"), sum(map(sig.count, "CVU"))
    consonants = max(map(len, _CONSONANTS.findall(sig)), default=0)
    return (
        f"kind={own_kind(sig)}", f"shape={form if len(form) <= 6 else f'runs{min(len(form), 30) // 6}'}", f"length={min(n, 64) // 4}", f"digits={-(-4 * digits // n)}",
        f"upper={-(-4 * upper // n)}", f"consonants={min(consonants, 7)}", f"groups={min(sum(r[0] == '9' for r in runs), 4)}", f"foreign={'u' in sig or 'U' in sig}",
    )


def letter_features(token: str, sig: str) -> tuple[str, ...]:
    """What needs the letters themselves: their variety, a known prefix, hexadecimal digits."""
    n = len(token)
    known = "9" in sig or sig[:1] in "CV" and n > 12
    prefix = next((p for p in _PREFIXES if token.startswith(p)), "-") if known or token[2:4].find("-") >= 0 or "_" in token[:4] else "-"
    return (f"variety={min(n, 32) // 4}:{-(-8 * len(set(token)) // n)}", f"prefix={prefix}", f"hexlike={n >= 8 and '9' in sig and all(c in string.hexdigits for c in token)}")


def file_features(text: str) -> tuple[int, int]:
    """How many marks of code or settings the text has (0 to 2), and whether it names a secret (0 or 1)."""
    marks = sum(map(text.count, "=;{}<>()")) / max(1, len(text))
    low = text.lower()
    return (2 if marks > 0.02 else 1 if marks > 0.004 else 0), int(any(w in low for w in _STRONG))


class _Words:
    """Numbers of tokens, and by number what the field needs to know of each; those rarely met are forgotten when they become too many.

    Number 0 is the gap between two texts. Most tokens are met once, so what is kept of each is packed.
    """

    def __init__(self, own: dict[str, np.ndarray], bias: np.ndarray):
        self.weights, self.bias, self.none = own, bias, np.zeros(3)
        self.ids: dict[str, int] = {"": 0}
        self.characters = self.of_classes = 0
        self.by_class: dict[str, tuple[int, np.ndarray]] = {}
        self.by_letters: dict[tuple[str, ...], np.ndarray] = {}
        self.near, self.own, self.score = array("b", [0]), array("b", [0]), array("d", [0.0, _FORBIDDEN, _FORBIDDEN])
        self.met = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keeps the tokens met more than once, the most met first, up to half of what may be remembered."""
        if len(self.by_class) > REMEMBERED // 8 or self.of_classes > CHARACTERS:
            self.by_class, self.of_classes = {}, 0
        if len(self.ids) <= REMEMBERED and self.characters <= CHARACTERS:
            return
        tokens = list(self.ids)
        often = 1 + np.flatnonzero(self.met[1:] > 1)
        often = often[np.argsort(-self.met[often], kind="stable")][: REMEMBERED // 2]
        lengths = np.cumsum([len(tokens[i]) for i in often])
        kept = np.concatenate([[0], often[: np.searchsorted(lengths, CHARACTERS // 2, "right")]]).astype(np.int64)
        near, own, score = self.look(kept)
        self.near, self.own, self.score = array("b", near.tobytes()), array("b", own.tobytes()), array("d", score.tobytes())
        self.ids = {tokens[i]: k for k, i in enumerate(kept)}
        self.characters, self.met = sum(map(len, self.ids)), np.zeros(len(kept), np.int64)

    def total(self, features: tuple[str, ...]) -> np.ndarray:
        return sum((self.weights.get(f, self.none) for f in features), self.none)

    def number(self, tokens: list[str]) -> list[int]:
        ids = self.ids
        for t in set(tokens).difference(ids):
            sig = classes(t)
            known = self.by_class.get(sig)
            if known is None:
                self.of_classes += len(sig)
                known = self.by_class[sig] = (OWN.index(own_kind(sig)), self.total(class_features(sig)) + self.bias)
            letters = letter_features(t, sig)
            more = self.by_letters.get(letters)
            if more is None:
                more = self.by_letters[letters] = self.total(letters)
            ids[t] = len(self.near)
            self.characters += len(t)
            self.near.append(_NEAR[near_kind(t, sig)])
            self.own.append(known[0])
            self.score.extend((known[1] + more).tolist())
        return list(map(ids.__getitem__, tokens))

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near, own, score of the tokens of these numbers, which count as met."""
        met = np.bincount(ids, minlength=len(self.near))
        met[: len(self.met)] += self.met
        self.met = met
        return np.frombuffer(self.near, np.int8)[ids], np.frombuffer(self.own, np.int8)[ids], np.frombuffer(self.score).reshape(-1, 3)[ids]


_NEAR = {k: i for i, k in enumerate(NEAR)}
_PASSED = np.array([k in ("copula", "assign", "quote", "delimiter") for k in NEAR])


def heads(near: np.ndarray) -> np.ndarray:
    """For each token the kind of word that introduces it."""
    at = np.arange(len(near))
    last = np.maximum.accumulate(np.where(_PASSED[near], -1, at))
    prev = np.concatenate([[-1], last[:-1]])
    strong, weak = near[prev] == _NEAR["strong"], near[prev] == _NEAR["weak"]
    met = np.flatnonzero((prev >= 0) & (at - prev - 1 <= GAP) & (strong | weak))
    out = np.zeros(len(near), np.int64)
    if len(met):
        assigned = np.concatenate([[0], np.cumsum(near == _NEAR["assign"])])
        stated = np.concatenate([[0], np.cumsum(near == _NEAR["copula"])])
        since = prev[met] + 1
        by = np.where(assigned[met] > assigned[since], 0, np.where(stated[met] > stated[since], 1, 2))
        out[met] = np.where(strong[met], 1, 4) + by
    return out


class Field:
    """Weights of a linear chain over TAGS."""

    def __init__(self):
        self.bias = np.zeros(3)
        self.own: dict[str, np.ndarray] = {}
        self.near = np.zeros((len(OFFSETS), len(NEAR), 3))
        self.head = np.zeros((len(HEADS), len(OWN), 3))
        self.marks, self.named = np.zeros((3, 3)), np.zeros((2, 3))
        self.move = np.zeros((4, 3))  # from O, B, I and the start (which counts as O does)
        self.move[0, 2] = self.move[3, 2] = _FORBIDDEN

    def words(self) -> _Words:
        return _Words(self.own, self.bias)

    def emissions(self, looked: tuple[np.ndarray, np.ndarray, np.ndarray], marks, named) -> np.ndarray:
        """Scores of the tags of a stretch of tokens, beyond which there is nothing."""
        near, own, score = looked
        out = score + self.head[heads(near), own] + (self.marks[marks] + self.named[named])
        wide = np.concatenate([[0, 0], near, [0, 0]])
        for k, d in enumerate(OFFSETS):
            out += self.near[k][wide[2 + d : 2 + d + len(near)]]
        return out

    def scores(self, tokens: list[str], file: tuple[int, int]) -> np.ndarray:
        words = self.words()
        return self.emissions(words.look(np.array(words.number(tokens))), *file) if tokens else np.zeros((0, 3))

    def viterbi(self, scores: np.ndarray, before: int = 3, after: int | None = None) -> list[int]:
        """The best path between two fixed neighbours (by default the start and the end)."""
        if not len(scores):
            return []
        move = self.move.tolist()
        best, back = [s + m for s, m in zip(scores[0].tolist(), move[before], strict=True)], []
        for s in scores[1:].tolist():
            frm = [max((0, 1, 2), key=lambda a, t=t: best[a] + move[a][t]) for t in (0, 1, 2)]
            best = [best[frm[t]] + move[frm[t]][t] + s[t] for t in (0, 1, 2)]
            back.append(frm)
        if after is not None:
            best = [x + move[a][after] for a, x in enumerate(best)]
        path = [max((0, 1, 2), key=best.__getitem__)]
        for frm in reversed(back):
            path.append(frm[path[-1]])
        return path[::-1]

    def lead(self) -> tuple[float, float, float]:
        """The most that a path can gain by moves into a tag other than O, out of it, and on to an I."""
        m = self.move
        enter = max(m[p, y] - m[p, 0] for p in range(4) for y in (1, 2) if m[p, y] > _FORBIDDEN / 2)
        leave = max(0.0, max(m[y, n] - m[0, n] for y in (1, 2) for n in (0, 1)))
        onward = max(m[y, 2] - m[0, 1] for y in (1, 2)) + max(0.0, max(m[2, n] - m[1, n] for n in range(3)))
        return enter, leave, onward

    def certain(self, scores: np.ndarray, following: np.ndarray, lead: tuple[float, float, float]) -> np.ndarray:
        """Which tokens are O on every best path; ``following`` has the scores of each one's next token.

        Were such a token B or I on a path, that path would gain by making it O, and B of an I right behind it.
        """
        enter, leave, onward = lead
        cut = np.maximum(following[:, 2] - following[:, 1], 0)
        return scores[:, 0] - scores[:, 1:].max(1) > enter + np.maximum(leave, onward + cut) + 1e-9

    def fit(self, examples: list[tuple[list[str], tuple[int, int], list[int]]]) -> Field:
        """Adagrad on the log likelihood, many examples at a time."""
        vocabulary: dict[str, int] = {}
        rows: dict[str, list[int]] = {}
        for tokens, _, _ in examples:
            for t in tokens:
                if t not in rows:
                    sig = classes(t)
                    rows[t] = [vocabulary.setdefault(f, len(vocabulary)) for f in (*class_features(sig), *letter_features(t, sig))]
        longest = max(len(t) for t, _, _ in examples)
        n, k = len(examples), len(next(iter(rows.values())))
        own, kind = np.zeros((n, longest, k), np.int64), np.zeros((n, longest), np.int64)
        near, head = np.zeros((n, longest, len(OFFSETS)), np.int64), np.zeros((n, longest), np.int64)
        tags, size, file = np.zeros((n, longest), np.int64), np.array([len(t) for t, _, _ in examples]), np.array([f for _, f, _ in examples])
        for i, (tokens, _, gold) in enumerate(examples):
            sigs = [classes(t) for t in tokens]
            kinds = np.array([_NEAR[near_kind(t, sig)] for t, sig in zip(tokens, sigs, strict=True)])
            wide = np.concatenate([[0, 0], kinds, [0, 0]])
            own[i, : len(tokens)], kind[i, : len(tokens)] = [rows[t] for t in tokens], [OWN.index(own_kind(sig)) for sig in sigs]
            near[i, : len(tokens)] = np.stack([wide[2 + d : 2 + d + len(tokens)] for d in OFFSETS], axis=1)
            head[i, : len(tokens)], tags[i, : len(tokens)] = heads(kinds), gold
        weights = {"own": np.zeros((len(vocabulary), 3)), "near": self.near, "head": self.head, "marks": self.marks, "named": self.named, "bias": self.bias, "move": self.move}
        seen = {name: np.full_like(w, 1e-2) for name, w in weights.items()}
        rng = np.random.default_rng(5)
        allowed = self.move > _FORBIDDEN / 2
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                b = order[at : at + BATCH]
                width = int(size[b].max())
                live = np.arange(width)[None, :] < size[b][:, None]
                o, kd, nr, hd = own[b, :width], kind[b, :width], near[b, :width], head[b, :width]
                s = weights["own"][o].sum(2) + self.head[hd, kd] + self.bias + self.marks[file[b, 0]][:, None] + self.named[file[b, 1]][:, None]
                for d in range(len(OFFSETS)):
                    s += self.near[d, nr[:, :, d]]
                g, moves = _gradient(s, live, tags[b, :width], size[b], self.move)
                flat = g.reshape(-1, 3)
                step = {
                    "own": _sums(o.reshape(-1), np.repeat(flat, k, axis=0), len(vocabulary)), "bias": flat.sum(0), "move": moves * allowed,
                    "near": np.stack([_sums(nr[:, :, d].reshape(-1), flat, len(NEAR)) for d in range(len(OFFSETS))]),
                    "head": _sums((hd * len(OWN) + kd).reshape(-1), flat, len(HEADS) * len(OWN)).reshape(self.head.shape),
                    "marks": _sums(file[b, 0], g.sum(1), 3), "named": _sums(file[b, 1], g.sum(1), 2),
                }
                for name, w in weights.items():
                    d = step[name] / len(b) - (L2 * w if name != "move" else 0)
                    seen[name] += d * d
                    w += STEP * d / np.sqrt(seen[name])
                self.move[~allowed] = _FORBIDDEN
        self.own = {f: weights["own"][i] for f, i in vocabulary.items()}
        return self


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by their place."""
    return np.stack([np.bincount(at, rows[:, c], n) for c in range(rows.shape[1])], axis=1)


def _gradient(s: np.ndarray, live: np.ndarray, tags: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected tags (example, place, tag) and moves (4, 3), by forward and backward sums."""
    n, width, _ = s.shape
    a, b = np.zeros_like(s), np.zeros_like(s)
    a[:, 0] = s[:, 0] + move[3]
    for i in range(1, width):
        a[:, i] = np.logaddexp.reduce(a[:, i - 1, :, None] + move[None, :3], axis=1) + s[:, i]
    for i in range(width - 2, -1, -1):
        ahead = np.logaddexp.reduce(move[None, :3] + (s[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
        b[:, i] = np.where(live[:, i + 1, None], ahead, 0)
    z = np.logaddexp.reduce(a[np.arange(n), size - 1], axis=1)
    p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[:, :, None]
    gold = np.eye(3)[tags] * live[:, :, None]
    moves = np.zeros((4, 3))
    for i in range(1, width):
        pairs = np.exp(np.minimum(a[:, i - 1, :, None] + move[None, :3] + (s[:, i] + b[:, i])[:, None, :] - z[:, None, None], 0))
        moves[:3] += np.einsum("na,nb->ab", gold[:, i - 1], gold[:, i]) - (pairs * live[:, i, None, None]).sum(0)
    moves[3] = (gold[:, 0] - p[:, 0]).sum(0)
    return gold - p, moves


class Tagger:
    """A field with what it has learned of the tokens met so far."""

    def __init__(self, field: Field):
        self.field, self.words, self.lead = field, field.words(), field.lead()

    def paths(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text the places of the tokens that aren't O, with their tags."""
        out: list[dict[int, int]] = [{} for _ in texts]
        some, tokens, n = [], [], 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                out[i] = self._long(text)
                continue
            some.append(i)
            tokens.append(_TOKEN.findall(text))
            n += len(tokens[-1])
            if n >= BLOCK:
                self._together(texts, some, tokens, out)
                some, tokens, n = [], [], 0
        self._together(texts, some, tokens, out)
        return out

    def _together(self, texts: list[str], some: list[int], tokens: list[list[str]], out: list[dict[int, int]]) -> None:
        """Tags several texts at once, with a gap behind each that nothing sees across."""
        if not some:
            return
        self.words.forget()
        ids: list[int] = []
        starts, file = [], []
        for i, ts in zip(some, tokens, strict=True):
            starts.append(len(ids))
            ids += self.words.number(ts)
            ids += [0] * 2
            file.append(file_features(texts[i]))
        sizes = [len(t) + 2 for t in tokens]
        marks, named = (np.repeat([f[k] for f in file], sizes) for k in (0, 1))
        scores = self.field.emissions(self.words.look(np.array(ids)), marks, named)
        loose = np.flatnonzero(~self.field.certain(scores, np.concatenate([scores[1:], scores[-1:]]), self.lead))
        for i, lo, size in zip(some, starts, sizes, strict=True):
            a, b = np.searchsorted(loose, (lo, lo + size - 2))
            if a < b:
                out[i] = self._decode([(int(p) - lo, scores[p]) for p in loose[a:b]], size - 2)

    def _long(self, text: str) -> dict[int, int]:
        """As for one text, in blocks: features see GAP + 1 tokens back and two on, certainty the next one's scores."""
        file, stream, back, on = file_features(text), (m[0] for m in _TOKEN.finditer(text)), GAP + 3, 4
        open_: list[tuple[int, np.ndarray]] = []
        held: list[str] = []
        start = total = 0
        while True:
            self.words.forget()
            block = list(islice(stream, BLOCK))
            held += block
            total += len(block)
            ended = len(block) < BLOCK
            if held:
                scores = self.field.emissions(self.words.look(np.array(self.words.number(held))), *file)
                following = np.concatenate([scores[1:], np.array([[0.0, 0.0, _FORBIDDEN]])])
                first = total - len(held)
                lo, hi = start - first, len(held) if ended else len(held) - on
                loose = np.flatnonzero(~self.field.certain(scores[lo:hi], following[lo:hi], self.lead)) + lo
                open_ += [(int(i) + first, scores[i]) for i in loose]
                start = first + hi
                held = held[max(0, hi - back) :]
            if ended:
                return self._decode(open_, total)

    def _decode(self, open_: list[tuple[int, np.ndarray]], total: int) -> dict[int, int]:
        out, k = {}, 0
        while k < len(open_):
            j = k
            while j + 1 < len(open_) and open_[j + 1][0] == open_[j][0] + 1:
                j += 1
            first, last = open_[k][0], open_[j][0]
            path = self.field.viterbi(np.array([s for _, s in open_[k : j + 1]]), 0 if first else 3, 0 if last + 1 < total else None)
            out.update((first + i, tag) for i, tag in enumerate(path) if tag)
            k = j + 1
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """(start, end) of the secrets that the field tags, for each text."""
        known = [t or "" for t in texts]
        found = []
        for text, path in zip(known, self.paths(known), strict=True):
            out: list[tuple[int, int]] = []
            if path:
                for i, m in enumerate(islice(_TOKEN.finditer(text), max(path) + 1)):
                    tag = path.get(i, 0)
                    if tag == 2 and out:
                        out[-1] = (out[-1][0], m.end())
                    elif tag:
                        out.append(m.span())
            found.append(out)
        return found


def field_spans(text: str | None, field: Field) -> list[tuple[int, int]]:
    return Tagger(field).spans([text])[0]


def _example(rng: random.Random, words: list[str]) -> tuple[str, tuple[int, int] | None]:
    """A line with a secret at a span, or one with something that only looks like one."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    phrase = lambda lo, hi: " ".join(rng.choices(words, k=rng.randint(lo, hi)))
    before, after = phrase(0, 6), phrase(0, 6)
    alnum = string.ascii_letters + string.digits
    kind = rng.randrange(20)
    if kind < 11:
        value = (
            lambda: pick(alnum + "+/", 40), lambda: pick(string.hexdigits.lower(), rng.choice((32, 40, 64))), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: rng.choice(("ghp_", "sk-", "xoxb-", "npm_")) + pick(alnum, rng.randint(24, 40)), lambda: pick(alnum, rng.randint(20, 60)) + rng.choice(("=", "==")),
            lambda: pick(alnum + "_-", 22), lambda: pick(string.ascii_letters, 9) + pick(string.digits, 3) + pick(alnum, 4),
            lambda: rng.choice(words) + pick(string.digits, rng.randint(1, 4)), lambda: "".join(rng.choices(words, k=8))[: rng.randint(14, 28)],
            lambda: rng.choice(words).replace("a", "@").replace("o", "0") + rng.choice("!$%&#") + pick(alnum, rng.randint(2, 6)),
            lambda: pick(alnum, 16) + " " + pick(alnum, 16) + (" " + pick(alnum, 16) if rng.random() < 0.4 else ""),
        )[kind]()
        keys = ("password", "secret", "token", "api_key", "client_secret", "DB_PASSWORD", "Authorization: Bearer", "passphrase", "PASSWD", "credential", "authToken", "pwd")
        key = rng.choice((*keys, "private key", "access_key", "key") if kind not in (7, 8, 9) else keys)
        if kind in (1, 2, 3) and rng.random() < 0.4:
            key = ""
        lead = f"{before} {key}{rng.choice((' = ', '=', ': ', ' is ', ' ', ' := ', ': ', '='))}" if key else f"{before} "
        quote = rng.choice(('"', "'", "", ""))
        if key and quote == '"' and rng.random() < 0.3:
            lead = f'{before} "{key}": '
        lead = lead.lstrip()
        at = len(lead) + len(quote)
        return f"{lead}{quote}{value}{quote}{rng.choice((' ', '. ', ', '))}{after}", (at, at + len(value))
    value = (
        lambda: f"+{rng.randint(1, 99)} 555-{rng.randint(1000, 9999)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"mail{rng.randint(1, 99)}.user{rng.randint(1, 999)}@example.com", lambda: f"https://site.example.com/page/{rng.randint(1000, 99999)}",
        lambda: "".join(rng.choices(words, k=rng.randint(3, 7))), lambda: pick(string.digits, rng.randint(8, 16)), lambda: f"version-{rng.randint(1, 9)}-{rng.randint(100, 999)}",
        lambda: f"{rng.choice(('password', 'token', 'secret', 'key', 'passphrase'))} {rng.choice(('is', 'was', 'that', 'for', 'of', ''))} {rng.choice(words)}",
        lambda: f"{rng.choice(('password', 'token', 'secret', 'API key'))}: {phrase(1, 4)}",
    )[kind - 11]()
    return f"{before} {value}{rng.choice((' ', '. ', rng.choice('#%*&$') * 3 + ' '))}{after}", None


def labelled(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The tokens of a text whose secrets are known, with their tags."""
    starts = [s for s, _ in spans]
    tokens, tags, open_ = [], [], -1
    for m in _TOKEN.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        inside = k >= 0 and m.start() < spans[k][1]
        tokens.append(m[0])
        tags.append((2 if open_ == k else 1) if inside else 0)
        open_ = k if inside else -1
    return tokens, tags


def mined_windows(text: str, width: int = WIDTH, most: int = WINDOWS) -> list[tuple[list[str], list[int]]]:
    """Windows of a text with its pattern matches as labels, spread over the text; doubtful ones are left out."""
    sure = sorted([(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] + [s[:2] for s in base_spans(text) if s[2] == "access"])
    tokens, tags = labelled(text, sure)
    hits = [i for i, tag in enumerate(tags) if tag == 1]
    spots = [*hits[:: max(1, 2 * len(hits) // most)][: most // 2], *range(0, len(tokens), max(width, 2 * len(tokens) // most))][:most]
    out = []
    for i in spots:
        at = max(0, i - width // 2)
        some, known = tokens[at : at + width], tags[at : at + width]
        doubtful = any(not tag and (keyword(t) == "strong" or own_kind(classes(t)) == "long code") for t, tag in zip(some, known, strict=True))
        if some and (any(known) or not doubtful) and known[0] != 2:
            out.append((some, known))
    return out


def train(docs: DataFrame | None = None, examples: int = 2400) -> Field:
    """The field, from written examples and from windows of some documents (column text)."""
    rng = random.Random(3)
    syllables = "ther on er ing and mo ve an the ed st nt es la ri to ka mi su del cor ra un".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(600)]
    words += [w.capitalize() for w in words[:100]] + "hunter correct horse battery staple summer winter dragon monkey required reset expired the of is for must be".split()
    data = []
    for _ in range(examples):
        line, span = _example(rng, words)
        tokens, tags = labelled(line, [span] if span else [])
        data.append((tokens, (rng.randrange(3), int(bool(span) or rng.random() < 0.5)), tags))
    if docs is not None:
        some = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
        every = max(1, some.count() // TRAIN_DOCS)

        def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in slices(batches, 64):
                found = [(d, *file_features(t), *w) for d, t in zip(b["digest"], b["text"], strict=True) for w in mined_windows(t)]
                yield pd.DataFrame(found, columns=["digest", "marks", "named", "tokens", "tags"])

        # A text that recurs trains once; TRAIN_DOCS * WINDOWS rows reach the driver at most.
        picked = some.select("text", F.xxhash64("text").alias("digest")).where(F.pmod("digest", F.lit(every)) == 0)
        rows = picked.mapInPandas(mine, "digest long, marks int, named int, tokens array<string>, tags array<int>").dropDuplicates()
        for r in rows.orderBy("digest", "tokens").limit(TRAIN_DOCS * WINDOWS).collect():
            data.append((list(r["tokens"]), (r["marks"], r["named"]), list(r["tags"])))
    return Field().fit([d for d in data if d[0]])


def all_spans(texts: list[str | None], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """For each text its base spans and the field's spans, in order; they may overlap."""
    return [sorted([*base_spans(t), *((s, e, "crf") for s, e in own)], key=lambda s: (s[0], KINDS.index(s[2]))) for t, own in zip(texts, tagger.spans(texts), strict=True)]


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, spans (array<struct<start, end, kind>>) of every row."""
    known = docs.sparkSession.sparkContext.broadcast(field)
    held: list[Tagger] = []

    def run(texts: list) -> list:
        held[:] = held or [Tagger(known.value)]
        return [[[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in all_spans(texts, held[0])]]

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return add_columns(rows, "text", "spans array<struct<start:int,end:int,kind:string>>", run).drop("text")


def redact(docs: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask`` (overlapping spans by one)."""
    known = docs.sparkSession.sparkContext.broadcast(field)
    held: list[Tagger] = []

    def run(texts: list) -> list:
        held[:] = held or [Tagger(known.value)]
        out = []
        for t, spans in zip(texts, all_spans(texts, held[0]), strict=True):
            if t is None:
                out.append(None)
                continue
            parts, upto = [], 0
            for s, e, _ in spans:
                if s >= upto:
                    parts += [t[upto:s], mask]
                upto = max(upto, e)
            out.append("".join([*parts, t[upto:]]))
        return [out]

    columns, name = docs.columns, fresh(docs, "__masked")
    masked = add_columns(docs, "text", f"`{name}` string", run)
    return masked.withColumn("text", F.col(name)).select(*columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, train(docs)).withColumnRenamed("spans", "found")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    met = lambda s: F.exists(F.filter("found", lambda b: b["kind"] != "crf"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("crf").alias("n_crf"),
        F.size(F.filter("found", lambda s: (s["kind"] == "crf") & ~met(s))).cast("long").alias("n_crf_alone"),
    )
