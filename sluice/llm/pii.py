"""Personal data by candidates and gradient boosting.

Base spans (email, ip, card, phone) follow fixed patterns and checks and are always kept.  Beside them, high-recall generators
propose overlapping spans: numbers in any grouping, dotted numbers, bank account shapes, words around an "@" or "(at)",
assignments to secret-like names, long keys.  Boosted trees score every proposal by its format and its context, the
odds are calibrated per kind on held-back proposals, and a proposal whose probability reaches the kind's threshold is
selected.  Of overlapping selections the likeliest stays; none overlaps a base span.

No document carries labels for personal data, so the trees learn from self-evident cases.  Positives agree with a base span, pass
the check of their kind (mod 97 for accounts, the email pattern for the plain form of an "(at)" address, a secret's fixed prefix)
or follow a word of their kind; negatives fail the check of their kind without such a word, or lie on a base span of another
kind; all other proposals are unlabelled and left out of fit and calibration.  The checks are no features, so proposals that look like
positives in like contexts are selected too; an obfuscated address is measured in its plain form.  Accounts, "(at)" addresses
and prefixed secrets that pass their check are selected whatever the trees say.  The fit uses the labelled proposals of at most
``max_documents`` documents (smallest hash of doc_id) and at most ``max_candidates`` of them.

Null text is empty text.  Offsets are code points, ends exclusive.  Repeated rows are answered alike.  An empty table gives an empty result.
Only doc_id and text are read; ``redact`` also keeps the other columns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.boosting import BoostedTrees
from sluice.llm.common import ship

KINDS = ("email", "ip", "card", "phone", "secret", "account")  # the order of kinds at one start
MAX_DOCUMENTS = 6_000
MAX_CANDIDATES = 60_000
PRECISION = 0.95
CONTEXT = 32
SPANS = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_account long, n_spans long")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*$")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")

# Generators: (name, needed characters, pattern).  Each pattern scans in time linear in the text: a run is entered at its start only
# and taken whole, whatever its length.
GENERATORS = (
    ("number", _DIGIT, re.compile(r"(?<![0-9])\+?[0-9](?:[ ().-]{0,2}[0-9]){6,}")),
    ("dotted", _DIGIT, re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}")),
    ("account", _DIGIT, re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?\b")),
    ("at", re.compile(r"@|\bat\b", re.I), re.compile(r"(?<![^\s<(\[\"',;:])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*", re.I)),
    ("assigned", re.compile(r"[:=]"), re.compile(r"\b(?:pass(?:word|wd)?|token|secret|api[_-]?key|access[_-]?key|auth|private[_-]?key)\b ?[:=] ?[\"']?([^\s\"']{6,})", re.I)),
    ("key", _DIGIT, re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+")),
)
_SIGN = re.compile(r" ?(?:\(at\)|\[at\]|@) ?", re.I)
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\.) ?", re.I)
_OBFUSCATED = re.compile(r"[(\[](?:at|dot)[)\]]", re.I)
_SENTENCE = re.compile(r"(?<! )\. ")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_ASSIGNED = re.compile(r"(?:password|token|secret|key) ?[:=] ?[\"']?$", re.I)
_WORDY = re.compile(r"[+/_-]*(?:[A-Za-z]+|[0-9]+)(?:[+/_-]+(?:[A-Za-z]+|[0-9]+))*[+/_-]*")  # words and numbers, as in a path
_SEED_SECRET = re.compile(r"AKIA[A-Z0-9]{16}$|ghp_[A-Za-z0-9]{36}$|sk-[A-Za-z0-9]{20,}$")
_CONTEXT_WORDS = (re.compile(r"\b(?:call|tel|phone|fax|mobile|cell)\b", re.I), re.compile(r"\b(?:mail|contact|write|e-mail)\b", re.I),
                  re.compile(r"\b(?:card|visa|credit|pay|iban|account|konto|compte|cuenta)\b", re.I),
                  re.compile(r"(?:pass|token|secret|key|auth)", re.I), re.compile(r"\b(?:ip|host|server|address|addr)\b", re.I),
                  re.compile(r"\b(?:version|release|section|isbn|issn|doi|page|id|nr|no)\b", re.I))
_WORD_OF = {"phone": _CONTEXT_WORDS[0], "card": _CONTEXT_WORDS[2], "account": _CONTEXT_WORDS[2], "secret": _CONTEXT_WORDS[3], "ip": _CONTEXT_WORDS[4]}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(value: str) -> bool:
    """Whether a bank account number has the length and the check digits of an IBAN."""
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def plain_address(value: str) -> str:
    """An address with its sign and dots put right."""
    return _DOT.sub(".", _SIGN.sub("@", value))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match starts where the run before its "@" does, or where the match before ends
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), "email"))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _NON_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def kind_of(generator: str, value: str) -> str | None:
    """The kind of a proposal; None where it has more digits than any kind allows."""
    if generator == "number":
        n = len(_NON_DIGIT.sub("", value))
        return "card" if 13 <= n <= 19 and not value.startswith("+") else "phone" if n <= 15 else None
    return {"dotted": "ip", "account": "account", "at": "email"}.get(generator, "secret")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all proposals; they may overlap."""
    out = set()
    for name, needed, pattern in GENERATORS:
        if needed.search(text):
            for m in pattern.finditer(text):
                s, e = m.span(m.re.groups and 1)
                if (kind := kind_of(name, text[s:e])) is not None:
                    out.add((s, e, kind))
                if name == "at" and (stop := _SENTENCE.search(text, s, e)):  # the address may end its sentence
                    out.add((s, stop.start(), "email"))
                if name == "account" and not mod97(text[s:e]):  # words in capitals may follow the number
                    ends = [k for k in range(s, e) if text[k] == " " and mod97(text[s:k])]
                    out.update((s, k, "account") for k in ends[-1:])
    return sorted(out)


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a proposal, without the checks that label it."""
    start, end, kind = span
    value = plain_address(text[start:end]) if kind == "email" else text[start:end]
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper, lower = sum(c.isupper() for c in value), sum(c.islower() for c in value)
    runs = re.findall(r"[0-9]+", value)
    _, n_each = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_counts=True)
    share = n_each / n
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    hexa = all(c in "0123456789abcdefABCDEF" for c in value)
    return [KINDS.index(kind), n, digits, digits / n, upper / n, lower / n, n - digits - upper - lower, len(runs),
            max(map(len, runs), default=0), min(map(len, runs), default=0), float(-(share * np.log2(share)).sum()), value.count("."), value.count("-"), value.count(" "),
            value.count("("), float(value[0] == "+"), float("@" in value), float(hexa), edge(before[-1:]), edge(after[:1]),
            *[float(bool(w.search(before))) for w in _CONTEXT_WORDS]]


def certain(value: str, kind: str) -> bool:
    """Whether a value passes a check that hardly any other text passes."""
    if kind == "account":
        return mod97(value)
    if kind == "email":
        return bool(_OBFUSCATED.search(value)) and not _SENTENCE.search(value) and bool(_ADDRESS.fullmatch(plain_address(value)))
    return kind == "secret" and bool(_SEED_SECRET.match(value))


def evidence(text: str, span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> int:
    """1: a proposal is self-evident; -1: it is evidently something else; 0: unlabelled."""
    start, end, kind = span
    value, before = text[start:end], text[max(0, start - CONTEXT):start]
    i = bisect_left(base, (start - 2, -1, ""))
    if any(k == kind and abs(s - start) <= 2 and abs(e - end) <= 2 for s, e, k in base[i:i + 4]):
        return 1
    if certain(value, kind) or (kind == "secret" and _ASSIGNED.search(before)):
        return 1
    over = {k for s, e, k in base[max(0, i - 4):i + 4] if s < end and start < e}
    if over:
        return 0 if kind in over else -1
    said, denied = kind in _WORD_OF and bool(_WORD_OF[kind].search(before)), bool(_CONTEXT_WORDS[5].search(before))
    if kind == "email":  # without a dotted domain it is no address
        return 0 if _ADDRESS.fullmatch(plain_address(value)) else -1
    if kind == "card":
        right = luhn(_NON_DIGIT.sub("", value))
        return int(said and not denied) if right else 0 if said else -1
    if kind == "phone":
        inside = text[start - 1:start].isalnum() or text[end:end + 1].isalnum()
        if inside or len(_NON_DIGIT.sub("", value)) > 15:
            return -1
        if said:
            return int(not denied)
        return -1 if denied or value.isdigit() else 0  # a bare run of digits is a count
    if kind == "secret":
        return 0 if said else -1 if denied or _WORDY.fullmatch(value) else 0
    return 0 if said else -1  # ip, account


class Detector:
    """Trees, calibration and thresholds by kind; without trees only what is certain is selected."""

    def __init__(self, trees: BoostedTrees | None, calibration: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.calibration, self.thresholds = trees, calibration, thresholds

    def probabilities(self, x: np.ndarray, kinds: list[str]) -> np.ndarray:
        odds = self.trees.score(x)
        a, b = (np.array([self.calibration.get(k, (1.0, 0.0))[i] for k in kinds]) for i in (0, 1))
        return 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))

    def select(self, texts: list[str], bases: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        """The added spans of every text."""
        out: list[list] = [[] for _ in texts]
        which, spans, rows = [], [], []
        for i, text in enumerate(texts):
            for c in candidates(text):
                which.append(i)
                spans.append(c)
                rows.append(features(text, c))
        if not rows:
            return out
        kinds = [s[2] for s in spans]
        sure = np.array([certain(texts[i][s:e], k) for i, (s, e, k) in zip(which, spans)])
        p = np.where(sure, 1.0, self.probabilities(np.array(rows), kinds) if self.trees is not None else 0.0)
        taken = [sorted((s, e) for s, e, _ in b) for b in bases]
        for k in np.lexsort(([-s[1] for s in spans], [s[0] for s in spans], which, -p, ~sure)):
            if not sure[k] and p[k] < self.thresholds.get(kinds[k], 2.0):
                continue
            start, end, _ = spans[k]
            held = taken[which[k]]
            at = bisect_left(held, (start, end))
            if (at < len(held) and held[at][0] < end) or any(e > start for _, e in held[max(0, at - 4):at]):
                continue
            held.insert(at, (start, end))
            out[which[k]].append(spans[k])
        return out


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn odds into calibrated odds (Platt's targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(odds * (target - p)).sum() - 1e-3 * (a - 1), (target - p).sum()])
        hess = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def learn(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_candidates: int = MAX_CANDIDATES, precision: float = PRECISION) -> Detector:
    """Fit on the labelled proposals of a bounded sample of documents; a quarter of them is held back for calibration."""
    ship(docs.sparkSession)
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_documents ids

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                for c in candidates(text):
                    label = evidence(text, c, base)
                    if not label:
                        continue
                    key = hashlib.md5(f"{c[2]}|{text[max(0, c[0] - 8):c[1] + 8]}".encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, c[2], features(text, c), int(label > 0)))
            yield pd.DataFrame(rows, columns=["key", "kind", "x", "y"])

    found = sample.mapInPandas(measure, "key string, kind string, x array<double>, y int") \
        .groupBy("key", "kind").agg(F.max(F.struct("y", "x")).alias("m")) \
        .orderBy("key").limit(max_candidates).select("key", "kind", "m.x", "m.y").toPandas()
    if len(found) < 40 or found["y"].nunique() < 2:
        return Detector(None, {}, {})
    x, y, kinds = np.array(found["x"].tolist()), found["y"].to_numpy(float), found["kind"].to_numpy()
    back = np.array([int(k[-1], 16) % 4 == 0 for k in found["key"]])
    if y[~back].min() == y[~back].max():
        return Detector(None, {}, {})
    trees = BoostedTrees().fit(x[~back], y[~back])
    odds = trees.score(x)
    calibration, thresholds = {}, {}
    for kind in KINDS:
        mine = back & (kinds == kind)
        if mine.sum() < 10 or y[mine].max() == 0:
            continue  # nothing to calibrate on: the kind selects nothing beyond the base
        calibration[kind] = a, b = calibrate(odds[mine], y[mine])
        p = 1 / (1 + np.exp(-np.clip(a * odds[mine] + b, -30, 30)))
        order = np.argsort(-p, kind="stable")
        exact = np.cumsum(y[mine][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(exact >= precision)
        thresholds[kind] = max(0.5, float(p[order][good[-1]])) if len(good) else 0.99
    return Detector(trees, calibration, thresholds)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """Per row: numbers of base spans, digest of the base spans, all spans, the number of added ones, how many of these are secrets and
    accounts, and the number of all spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(lo, 256).to_pylist()]
                bases = [base_spans(t) for t in texts]
                for base, added in zip(bases, detector.select(texts, bases)):
                    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
                    out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added),
                                *(sum(k == kind for _, _, k in added) for kind in ("secret", "account")), len(base) + len(added)))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[k] for r in out], kind) for k, kind in enumerate(
                [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 4)], [c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with every span in text replaced by its kind in brackets."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        plain = [t or "" for t in texts]
        bases = [base_spans(t) for t in plain]
        out = []
        for text, base, added in zip(plain, bases, detector.select(plain, bases)):
            at, parts = 0, []
            for s, e, k in sorted(base + added):
                if s >= at:
                    parts += [text[at:s], f"[{k}]"]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]))
        return pd.Series([o if t is not None else None for o, t in zip(out, texts)])

    return docs.withColumn("text", cleaned(F.col("text")))
