"""Personal data by weak supervision.

Fixed patterns give the base spans: these stay. Looser patterns give candidates besides. On each
candidate labelers that look at different things vote for, against or not at all: its shape (regular expressions), a gazetteer of
what its parts are known by (domains, issuers, key prefixes), the words before it, what stands next to it, and the variety of its
characters. Votes and features of all candidates of all documents are counted by pattern (a bounded number of patterns),
expectation-maximisation estimates from the votes how reliable each labeler is and how likely each pattern is personal
data, and a logistic classifier of votes and features of the span (kind, length, share of digits) is trained on these soft labels.
Candidates it accepts become spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, map_rows, saved, table

KINDS = ("email", "ip", "card", "phone", "number", "secret", "address")
#: The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does: a run is read once, however long it is.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What candidates look like, by kind; addresses are read from the mark in their middle, keys from the start of a run.
MARK = re.compile(r" ?(?:\(at\)|\[at\]) ?")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+")
NUMBER = re.compile(r"(?<![\w+.])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w.])|(?<![\w+.-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w+.-])\d{12,19}(?!\w)", re.A)
#: Words that go with personal data, and words that go with other numbers, in the text before.
CUES = frozenset("mail email e-mail contact tel phone call fax mobile card visa account iban ssn passport key token secret password passwd pwd api".split())
OTHERS = frozenset("isbn issn doi page pages volume year price total order item version id line commit sha hash checksum revision".split())
#: What parts of personal data are known by: ends of domains, starts of keys, starts of card numbers.
DOMAINS = frozenset("com org net edu gov info biz mil int eu io de fr es it uk nl at ch pl se no dk fi pt be ie us ca mx br ar cl jp cn in au nz za ru".split())
PREFIXES = ("AKIA", "ASIA", "AIza", "eyJ", "ghp_", "gho_", "ghs_", "glpat-", "npm_", "pypi-", "sk-", "sk_", "pk_", "rk_", "xoxb-", "xoxp-", "SG_", "ya29")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
LABELERS = ("shape", "gazetteer", "context", "beside", "variety")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """All matches of the address pattern, found from each @ instead of from each character."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = LOCAL.match(text, s) if s < at else None
        if m:
            out.append(m.span())
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def votes(kind: str, text: str, s: int, e: int) -> str:
    """One character a labeler: + for, - against, 0 abstains."""
    span, before = text[s:e], text[max(0, s - 40) : s].lower()
    digits = "".join(c for c in span if c in "0123456789")
    n, kinds = len(digits), len(set(span))
    if kind == "number":
        shape = "+" if n in (9, 10) and not span.isdigit() or 13 <= n <= 16 and luhn(digits) else "-" if span.isdigit() else "0"
        if n == 9:
            gazetteer = "-" if span.startswith(("000", "666", "9")) or span[4:6] == "00" or span.endswith("0000") else "+"
        elif n == 10:
            gazetteer = "+" if digits[0] > "1" and digits[3] > "1" else "-"
        else:
            gazetteer = "+" if 13 <= n and ISSUERS.match(digits) else "0"
        variety = "-" if len(set(digits)) < 4 else "+" if len(set(digits)) >= 6 else "0"
    elif kind == "secret":
        plain = re.split(r"[/_+=-]", span)
        cases = (span.upper() != span) + (span.lower() != span) + (n > 0)
        shape = "+" if len(span) in (32, 40, 64) and not re.search(r"[^0-9a-f]", span) or cases == 3 and len(plain) <= 3 else "-" if len(plain) > 4 else "0"
        gazetteer = "+" if span.startswith(PREFIXES) else "0"
        variety = "+" if kinds >= 12 else "-" if kinds < 8 else "0"
    else:
        shape = "+" if "(dot)" in span or "[dot]" in span or re.match(r"[^ ]+\.[A-Za-z]+$", span.split(")")[-1].split("]")[-1].strip()) else "0"
        last = re.split(r"[^a-z]+", span.lower())[-1]
        gazetteer = "+" if last in DOMAINS else "-"
        variety = "+" if kinds >= 8 else "-"
    near = re.findall(r"[a-z-]+", before)[-4:]
    context = "+" if CUES & set(near) else "-" if OTHERS & set(near) else "0"
    left, right = text[s - 1 : s] if s else " ", text[e : e + 1] or " "
    beside_ = "+" if (left.isspace() or left in "(<:[\"'=") and (right.isspace() or right in ")>].,;:!?\"'") else "-" if left.isalnum() or right.isalnum() else "0"
    return shape + gazetteer + context + beside_ + variety


def features(span: str) -> str:
    """Length (by powers of two) and share of digits (by quarters) of a span, a character each."""
    return str(min(7, len(span).bit_length())) + str(min(3, 4 * sum(c in "0123456789" for c in span) // len(span)))


def looser(text: str):
    """(kind, start, end) of what the looser patterns find, kind by kind, from left to right."""
    if "(at)" in text or "[at]" in text:
        free = 0
        for m in MARK.finditer(text):
            s = m.start()
            while s > free and text[s - 1] in LOCAL_CHARS:
                s -= 1
            domain = DOMAIN.match(text, m.end()) if s < m.start() else None
            free = m.end()
            if domain:
                free = domain.end()
                yield "address", s, free
    if DIGIT.search(text):
        for m in SECRET.finditer(text):
            letters = sum(c.isalpha() for c in m[0])
            if letters >= 4 and sum(c in "0123456789" for c in m[0]) >= 4:
                yield "secret", *m.span()
        for m in NUMBER.finditer(text):
            yield "number", *m.span()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, pattern) of what the looser patterns find apart from base spans and each other."""
    out: list[tuple[int, int, int, str]] = []
    taken: list[tuple[int, int]] = []  # apart from each other, by place
    for s, e in sorted((s, e) for s, _, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((s, e))
    for kind, s, e in looser(text):
        k = bisect_left(taken, (e, 0))  # those before k start before e
        if not k or taken[k - 1][1] <= s:
            insort(taken, (s, e))
            out.append((s, KINDS.index(kind), e, f"{kind} {votes(kind, text, s, e)} {features(text[s:e])}"))
    return sorted(out)


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """How likely each pattern ("kind votes features", a vote a labeler) is personal data, by its votes.

    Two classes; each labeler has a chance of every vote in each class. Starts from majorities, one
    smoothing count a vote keeps chances off 0. Patterns without votes on either side stay at one half.
    """
    names = sorted(counts)
    if not names:
        return {}
    rows = np.array([["-0+".index(c) for c in p.split()[1]] for p in names])
    weight = np.array([counts[p] for p in names], dtype=float)
    lean = (rows - 1).sum(axis=1)
    q = 1 / (1 + np.exp(-1.5 * lean))
    for _ in range(rounds):
        logit = np.full(len(names), np.log((weight @ q + 1) / (weight @ (1 - q) + 1)))
        for k in range(rows.shape[1]):
            hits = rows[:, k][:, None] == np.arange(3)
            yes, no = (weight * q) @ hits + 1, (weight * (1 - q)) @ hits + 1
            logit += np.log((yes / yes.sum()) / (no / no.sum()))[rows[:, k]]
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(names, q.tolist()))


def classifier(soft: dict[str, float], counts: dict[str, int], rounds: int = 400) -> dict[str, float]:
    """The chance that the trained logistic classifier gives each pattern: it sees votes, kind, length and share of digits."""
    names = sorted(soft)
    if not names:
        return {}
    parts = [p.split() for p in names]
    x = np.array([[*(c == "+" for c in v), *(c == "-" for c in v), *(kind == k for k in KINDS), *(f[0] == c for c in "4567"), *(f[1] == c for c in "0123"), 1.0] for kind, v, f in parts], dtype=float)
    y, w = np.array([soft[p] for p in names]), np.array([counts[p] for p in names], dtype=float)
    w, b = w / w.sum(), np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1]), x.T @ (w * (y - p)) - 1e-4 * b)
        b += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))).tolist()))


SPANS = "array<struct<start:int,kind:int,end:int>>"
CANDIDATES = "array<struct<start:int,kind:int,end:int,pattern:string>>"


def scanned(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with base (spans) and found (candidates) of each whole text, of any length; null counts as empty.
    A column of ``keep`` named base or found gives way."""

    def make():
        def work(batch):
            base, found = [], []
            for t in batch.column(0):
                t = t.as_py() or ""
                own = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                found.append([{"start": s, "kind": k, "end": e, "pattern": p} for s, k, e, p in candidates(t, own)])
            return [*batch.columns[1:], base, found]

        return work

    rows, schema = beside(df, text, keep, f"base {SPANS}, found {CANDIDATES}")
    return map_rows(rows, make, schema)


def accepted(found: DataFrame, least: float = 0.5) -> list[str]:
    """Vote patterns that the classifier trained on all candidates accepts."""
    rows = found.select(F.explode("found.pattern").alias("p")).groupBy("p").count().collect()  # 3 kinds x 3^5 votes x 4 lengths x 4 shares at most
    counts = {r["p"]: r["count"] for r in rows}
    scores = classifier(estimate(counts), counts)
    return sorted(p for p, x in scores.items() if x > least)


def all_spans(patterns: list[str]) -> Column:
    """Base spans and accepted candidates, by start, then kind."""
    chosen = F.filter("found", lambda c: c["pattern"].isin(patterns)) if patterns else F.filter("found", lambda c: F.lit(False))
    plain = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", plain))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span (start, kind, end) replaced by its kind in angle brackets; of overlapping spans the first to start
    covers, and what a later one has beyond it goes too."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out.append(f"{text[at:s]}<{KINDS[k]}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, patterns: list[str], text: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` with base spans and candidates of the accepted ``patterns`` replaced in ``text``, and ``length`` (if there is such a column) set
    to the code points of the texts that changed. A null text stays null; each text goes to Python once and comes back once."""
    chosen, names = frozenset(patterns), df.columns
    at, size = names.index(text), names.index(length) if length in names else None

    def make():
        def work(batch):
            out, sizes = [], batch.column(size).to_pylist() if size is not None else []
            for k, t in enumerate(batch.column(at)):
                t = t.as_py()
                own = base_spans(t) if t else []
                spans = own + [(s, kind, e) for s, kind, e, p in candidates(t, own) if p in chosen] if t else own
                if spans:
                    t = redact(t, spans)
                    if size is not None:
                        sizes[k] = len(t)
                out.append(t)
            return [out if c == at else sizes if c == size else x for c, x in enumerate(batch.columns)]

        return work

    return map_rows(df, make, beside(df, text, names, "_none int")[1].removesuffix(", _none int"))


def op3_pii(spark, sf_dir):
    """Personal data in every document.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty one.
    """
    found = saved(scanned(table(spark, sf_dir, "documents"), ["doc_id"]), "pii")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    spans = all_spans(accepted(found))
    return found.select("doc_id", n(0), n(1), n(2), n(3), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"))
