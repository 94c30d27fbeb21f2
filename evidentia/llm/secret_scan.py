"""Secret scan: base patterns and a linear-chain conditional random field.

A text is split into tokens. Each token has features of its own shape, of its
neighbours (a keyword or an assignment sign before it) and of its file (share of code
signs, presence of credential words). The field tags tokens B (secret begins), I
(inside) or O and is decoded by Viterbi. Weights are trained on the driver by
stochastic gradients of the log-likelihood over seeded synthetic lines.

Tokens that cannot belong to a secret (short plain words; see _MAY) are O by definition.
Such a token cuts the chain, so decoding the runs between them gives what Viterbi over the
whole text gives, at a fraction of the work (tests compare the two).

Spans are code points, end exclusive. Base spans always stay; the field adds spans of
kind crf that overlap no base span.

Defined cases: null and empty texts give zeros and empty strings. Repeated rows give
repeated results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- the field ---------------------------------------------------------------

TAGS = ("O", "B", "I")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]")
#: Only these tokens may be tagged B or I; all others are O by the field's definition. A token of eight or
#: more key characters with a digit, an inner capital or a sign in it, or of sixteen and more whatever it is;
_MAY = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?:(?=[A-Za-z0-9+/_.\-]{8})(?=[A-Za-z+/_.\-]*[0-9]|[A-Z]*[a-z0-9+/_.\-]+[A-Z]|[A-Za-z0-9]+[+/_\-])[A-Za-z0-9+/_.\-]+|[A-Za-z0-9+/_.\-]{16,})")
#: and any token of eight and more that an assignment to a credential word precedes.
_AFTER = re.compile(r"(?:key|secret|token|passw|pwd|auth|bearer|credential|private)[A-Za-z_\-]{0,16}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.\-]{8,})", re.I)
_CRED = re.compile(r"key|secret|token|passw|pwd|auth|bearer|credential|private", re.I)
_KEY_SIGN = re.compile(r"[A-Za-z0-9+/_.\-]")
#: Tokens before and after a token that its features look at.
BEFORE, AFTER = 9, 1


def shape(tok: str) -> list[str]:
    n, digits = len(tok), sum(c.isdigit() for c in tok)
    up, lo = any(c.isupper() for c in tok), any(c.islower() for c in tok)
    f = ["n" + str(min(6, n // 8)), "cls" + ("U" if up else "") + ("l" if lo else "") + ("d" if digits else "") + ("s" if not tok.isalnum() else "")]
    if n >= 16:
        f.append("d%d" % (4 * digits // n))
        turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(tok, tok[1:]))
        f.append("turns%d" % min(4, 8 * turns // n))
        f.append("dots" if tok.count(".") + tok.count("/") + tok.count("-") > 2 else "nodots")
    else:
        f.append("short")
    if n == 1 and not tok.isalnum():
        f.append("sign" + tok if tok in "\"'=:" else "sign")
    if _CRED.search(tok):
        f.append("cred")
    return f


def features(tokens: list[str], file: list[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    out = []
    for i, s in enumerate(shapes):
        f = list(s)
        for d in (1, 2, 3, 4):
            if i >= d:
                f += [f"-{d}{x}" for x in shapes[i - d] if x == "cred" or x.startswith("sign")]
        if "short" not in s:
            f += ["long&" + x for x in file]
            if any("cred" in shapes[j] for j in range(max(0, i - 5), i)):
                f.append("long&credbefore")
        if i + 1 < len(shapes):
            f += [f"+1{x}" for x in shapes[i + 1] if x.startswith("sign")]
        out.append(f)
    return out


def file_features(text: str) -> list[str]:
    signs = sum(map(text.count, "=:{}();\"'"))
    return ["code%d" % min(3, 100 * signs // (len(text) + 1)), "credfile" if any(k in text for k in ("key", "token", "secret", "KEY", "TOKEN")) else "nocred"]


class Field:
    """Weights of (feature, tag) and of (tag, tag); start counts as after O."""

    def __init__(self) -> None:
        self.unary: dict[str, np.ndarray] = {}
        self.pair = np.zeros((3, 3))
        self.pair[0, 2] = -50.0  # I never follows O

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(3)
        return np.array([sum((self.unary.get(f, zero) for f in fs), zero) for fs in feats])

    def viterbi(self, feats: list[list[str]], may: list[bool] | None = None) -> list[int]:
        """The best tags; where may is false the tag is O."""
        if not feats:
            return []
        s = self.scores(feats)
        if may is not None:
            s[~np.array(may), 1:] = -np.inf
        best, back = s[0] + self.pair[0], []
        for row in s[1:]:
            way = best[:, None] + self.pair
            back.append(way.argmax(0))
            best = way.max(0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def step(self, feats: list[list[str]], gold: list[int], rate: float) -> None:
        """One step up the log-likelihood of a sequence (forward and backward sums)."""
        s, n = self.scores(feats), len(feats)
        lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
        f, b = np.zeros((n, 3)), np.zeros((n, 3))
        f[0] = s[0] + self.pair[0]
        for i in range(1, n):
            f[i] = s[i] + lse(f[i - 1][:, None] + self.pair, 0)
        for i in range(n - 2, -1, -1):
            b[i] = lse(self.pair + (s[i + 1] + b[i + 1])[None], 1)
        z = lse(f[-1], 0)
        p = np.exp(f + b - z)
        for i, fs in enumerate(feats):
            g = -p[i]
            g[gold[i]] += 1
            for x in fs:
                w = self.unary.setdefault(x, np.zeros(3))
                w += rate * (g - 1e-3 * w)
        for i in range(1, n):
            q = np.exp(f[i - 1][:, None] + self.pair + (s[i] + b[i])[None] - z)
            q[0, 2] = 0
            self.pair -= rate * q
            if gold[i - 1] != 0 or gold[i] != 2:
                self.pair[gold[i - 1], gold[i]] += rate


def _examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Synthetic lines with the places of their secrets."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(2, 11)))
    prose = lambda k: " ".join(word() for _ in range(k))
    key = lambda abc, a, b: "".join(r.choice(abc) for _ in range(r.randint(a, b)))
    low, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for i in range(n):
        secret, kind = None, i % 10
        if kind < 4:
            letters = mixed[:52]
            secret = [key(low, 32, 64), key(mixed + "+/", 24, 48), "ghp_" + key(mixed, 30, 36), "sk-" + key(mixed, 24, 48), key(letters, 20, 40), key(mixed, 10, 16)][r.randrange(6)]
            name = r.choice(["api_key", "auth_token", "client_secret", "password", "PRIVATE_KEY", "access-token", "bearer", "credential"])
            how = r.choice(["%s = \"%s\"", "%s: %s", "'%s': '%s'", "%s=%s", "export %s=%s", "%s = %s"])
            line = prose(r.randint(0, 6)) + " " + how % (name, secret) + " " + prose(r.randint(0, 6))
        elif kind == 4:
            line = prose(12) + ". " + key("0123456789", 16, 16) + " " + prose(3)
        elif kind == 5:
            line = f"see https://{word()}.example.com/{word()}/{r.randint(1, 9999)}/{word()}-{word()}?page={r.randint(1, 9)} {prose(4)}"
        elif kind == 6:
            line = f"{word()}_{word()}_{r.randint(10, 99)}_{word()} = {word()}({r.randint(1, 10**6)}); {word()}.{word()}.{word()}2.{word()}@{word()}.example.com"
        elif kind == 8:
            camel = word() + "".join(word().title() for _ in range(r.randint(1, 3)))
            line = prose(4) + f" {camel} = {word().title()}{word().title()}({word()}_{word()}); {word().upper()}_{word().upper()} {word()}{word()}{word()} " + prose(4)
        elif kind == 9:
            line = prose(5) + " the " + r.choice(["token", "key", "secret", "password", "author"]) + f" {word()}{word()}{word()} " + prose(3) + ": " + word() + word() + " " + prose(4)
        else:
            line = prose(15) + f" {r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)} +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        at = line.find(secret) if secret else -1
        yield line, [(at, at + len(secret))] if secret else []


def train(n: int = 480, rounds: int = 3, seed: int = 7) -> Field:
    """A field trained on n synthetic lines."""
    field, data = Field(), list(_examples(n, seed))
    for k in range(rounds):
        for line, gold in data:
            toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)]
            tags = []
            for a, b, _ in toks:
                g = next((g for g in gold if a < g[1] and b > g[0]), None)
                tags.append(0 if g is None else 1 if a <= g[0] else 2)
            field.step(features([t for *_, t in toks], file_features(line)), tags, 0.3 / (1 + k))
    return field


def _may(text: str) -> set[int]:
    """Starts of the tokens that may be tagged."""
    return {m.start() for m in _MAY.finditer(text)} | {m.start(1) for m in _AFTER.finditer(text)}


def field_spans(text: str, field: Field, whole: bool = False) -> list[tuple[int, int]]:
    """Spans tagged B I*.

    A token that must be O cuts the chain: what stands before and after it is decoded apart, with the same
    result. So only runs of tokens that may be tagged are decoded, each up to the token after it, with the
    features that the whole text gives them; whole decodes all tokens at once.
    """
    may = _may(text) if text else set()
    if not may:
        return []
    file = file_features(text)
    out: list[tuple[int, int]] = []

    def tag(toks: list[tuple[int, int, str]], feats: list[list[str]]) -> None:
        for (s, e, _), t in zip(toks, field.viterbi(feats, [x[0] in may for x in toks]), strict=True):
            if t == 1:
                out.append((s, e))
            elif t == 2:
                out[-1] = (out[-1][0], e)

    if whole:
        toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        tag(toks, features([t for *_, t in toks], file))
        return out
    starts, done = sorted(may), 0
    for at in starts:
        if at < done:
            continue
        back = max(0, at - 400)  # enough for BEFORE tokens, unless they are long
        while True:
            while back > 0 and (_KEY_SIGN.match(text, back - 1) and _KEY_SIGN.match(text, back)):
                back -= 1  # at a token's border
            ahead = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, back, at)]
            if len(ahead) >= BEFORE or not back:
                break
            back = max(0, back - 4000)
        ahead = ahead[-BEFORE:]
        run: list[tuple[int, int, str]] = []
        rest: list[tuple[int, int, str]] = []
        for m in _TOKEN.finditer(text, at):
            (rest if rest or m.start() not in may else run).append((m.start(), m.end(), m[0]))
            if len(rest) > AFTER:
                break
        feats = features([t for *_, t in ahead + run + rest], file)
        end = len(ahead) + len(run) + min(1, len(rest))
        tag(run + rest[:1], feats[len(ahead) : end])
        done = run[-1][1]
    return out


def scan(text: str | None, field: Field) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans by start, and the number that the field tags, those on base spans included."""
    if not text:
        return [], [], 0
    base, tagged = base_spans(text), field_spans(text, field)
    more = [(a, b, "crf") for a, b in tagged if all(b <= s or a >= e for s, e, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], (*KINDS, "crf").index(s[2]))), len(tagged)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_tagged (by the field); one pass, no shuffle."""
    field = field or train()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py(), field) for t in b.column(1)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, *_ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, *_ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(sha, pa.string()), pa.array([_joined(x) for _, x, _ in found], pa.string()), pa.array([n for *_, n in found], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_tagged"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
