"""Operator 9: personal data and secrets by patterns, checksums and nearby words."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm.arrow import map_texts, slices
from strandcut.llm.registry import query, table

#: Base kinds in their order; further kinds follow.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "nino", "private_key", "token", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}

# A pattern that may start anywhere in a long run is quadratic. Here the run itself
# is matched, with the rest of the pattern optional: the leftmost match of the plain
# pattern starts where its run starts, and if it fails there it fails in all of the run.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NINO = re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?:\x20?[0-9]{2}){3}\x20?[A-D](?![A-Za-z0-9])")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
# Prefixes and lengths of well-known access tokens.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}"
    r"|glpat-[A-Za-z0-9_-]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,255}|[sr]k_live_[A-Za-z0-9]{16,255}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,2000}\.eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,2000})(?![A-Za-z0-9_-])"
)
#: What a text must hold, cheaply looked up, before a slow pattern is tried: of a token; of a name of a secret and
#: of the words without which a national number is not kept, in lower case.
TOKEN_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "AIza", "eyJ")
SECRET_PARTS = ("token", "secret", "passw", "pwd", "credential", "key")
NINO_PARTS = ("insurance", "nino", "number")
#: A run that may be a secret: it starts where no such character stands before it, so a long text is read once.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: What gives a run its meaning when it stands right before it, with a sign of assignment between.
ASSIGNED = re.compile(
    r"(?i:(?:api|access|auth|private|secret|client|signing|encryption)?[_ -]?(?:token|secret|passwd|password|pwd|credential|key))"
    r"(?:[_ -]?(?i:id|value|hash))?[\"']?\s{0,4}(?::=|=>|=|:)\s{0,4}[\"'`]?\Z"
)
#: A run's least bits for each character, and the characters before it that are searched.
ENTROPY, BEFORE = 3.0, 64

#: Whole words, plurals included, that raise a kind's score when they stand near a span, on either side.
CONTEXT = {
    "email": ("e-?mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "master", "mastercard", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "tax", "taxpayer"),
    "nino": ("national insurance", "nino", "ni number", "insurance number"),
    "private_key": ("key", "private", "certificate"),
    "token": ("token", "key", "secret", "credential", "auth", "bearer"),
    "secret": ("token", "key", "secret", "password", "credential", "auth", "bearer"),
}
NEAR = {
    kind: re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(words)})(?:e?s)?(?![A-Za-z0-9])".replace(" ", r"\s+"), re.I | re.A)
    for kind, words in CONTEXT.items()
}
#: Score of a confirmed pattern, without context; with it, half of the rest is added.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "nino": 0.4, "private_key": 1.0, "token": 0.9, "secret": 0.8}
LEAST = 0.5
#: Near is what stands in the span's sentence, which may go over lines, within FAR characters, or within REACH characters anyhow.
REACH, FAR = 40, 400
STOP = re.compile(r"[.!?](?=\s)|\n[^\S\n]*\n")

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def entropy(run: str) -> float:
    """Bits for each character by the run's own frequencies."""
    return -sum(n / len(run) * log2(n / len(run)) for n in Counter(run).values())


def _keys(text: str):
    """Private key blocks, each up to its own end line; one without an end is its begin line."""
    ends = [m.span() for m in KEY_END.finditer(text)] if "PRIVATE KEY" in text else []
    begins = [m.span() for m in KEY_BEGIN.finditer(text)] if "PRIVATE KEY" in text else []
    for (start, stop), after in zip(begins, [*(b[0] for b in begins[1:]), len(text)]):
        i = bisect_left(ends, (stop, stop))
        yield start, ends[i][1] if i < len(ends) and ends[i][0] < after else stop


def _secrets(text: str):
    """Runs of random characters that are assigned to a name of a secret."""
    for m in RUN.finditer(text):
        if not ASSIGNED.search(text, max(0, m.start() - BEFORE), m.start()):
            continue
        run = m[0].rstrip("=")
        if any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run) and entropy(run) >= ENTROPY:
            yield m.span()


def _iban_end(m: re.Match[str]) -> int | None:
    """Where the longest part of the match that ends at a blank (or is all of it) and fulfils mod 97 ends."""
    got = m[0]
    while got:
        bare = got.replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            return m.start() + len(got)
        got = got.rpartition(" ")[0]
    return None


def _proposed(text: str):
    """Confirmed matches, kind by kind."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            if m[1]:
                yield m.start(), m.end(), "email"
    for m in IP.finditer(text):
        if m[1] and all(map(_small, m[0].split("."))):
            yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    at = 0
    while m := IBAN.search(text, at):
        end = _iban_end(m)
        at = end or m.start() + 1
        if end:
            yield m.start(), end, "iban"
    for m in SSN.finditer(text):
        yield m.start(), m.end(), "ssn"
    low = text.lower()
    if any(part in low for part in NINO_PARTS):
        for m in NINO.finditer(text):
            yield m.start(), m.end(), "nino"
    for start, end in _keys(text):
        yield start, end, "private_key"
    taken = [m.span() for m in TOKEN.finditer(text)] if any(part in text for part in TOKEN_PARTS) else []
    for start, end in taken:
        yield start, end, "token"
    if any(part in low for part in SECRET_PARTS):
        known = {start for start, _ in taken}
        for start, end in _secrets(text):
            if start not in known:
                yield start, end, "secret"


def _near(start: int, end: int, stops: Sequence[int], words: Sequence[tuple[int, int]]) -> bool:
    """Whether a word stands near a span, outside of it; places of stops and words are in order."""
    at = bisect_left(stops, start)
    low = min(start - REACH, max(start - FAR, stops[at - 1] if at else 0))
    at = bisect_left(stops, end)
    high = max(end + REACH, min(end + FAR, stops[at] if at < len(stops) else end + FAR))
    before = bisect_right(words, start, key=lambda w: w[1])
    after = bisect_left(words, end, key=lambda w: w[0])
    return (before > 0 and words[before - 1][0] >= low) or (after < len(words) and words[after][1] <= high)


def find(text: str | None) -> list[Span]:
    """Spans ``(start, end, kind, score)`` in code points, by start, then kind.

    Base kinds are kept whatever their score; others need ``LEAST``.
    """
    text, out = text or "", []
    found = list(_proposed(text))
    if not found:
        return out
    stops = [m.start() for m in STOP.finditer(text)]
    words = {kind: [m.span() for m in NEAR[kind].finditer(text)] for kind in {f[2] for f in found}}
    for start, end, kind in found:
        score = SCORES[kind]
        if _near(start, end, stops, words[kind]):
            score += (1 - score) / 2
        if kind in BASE or score >= LEAST:
            out.append((start, end, kind, score))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def masked(text: str | None, spans: Sequence[Span]) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its first kind in brackets."""
    if not spans:
        return text
    out, done = [], 0
    at, until, kind = spans[0][:3]
    for start, end, k, _ in [*spans[1:], (len(text) + 1, len(text) + 1, "", 0.0)]:
        if start < until:
            until = max(until, end)
            continue
        out += [text[done:at], f"[{kind.upper()}]"]
        done, at, until, kind = until, start, end, k
    return "".join([*out, text[done:]])


SCHEMA = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string,score:double>>, masked string"
ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()),
    ]))),
    ("masked", pa.string()),
])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, masked`` of every document, row for row.

    Patterns propose spans leftmost and without overlap inside a kind; numbers
    are confirmed by range, length, Luhn or mod 97; of an IBAN's groups those
    are taken that fulfil it, the most first. Secrets are private key blocks,
    tokens of well-known form, and runs of at least 16 characters with digits,
    letters and ``ENTROPY`` bits a character that a name such as ``api_key`` is
    set to. Words near a span, before or after
    it, raise its score. Null text counts as empty and stays null when masked.
    Repeated rows stay; other columns are left out; an empty table gives none.
    """
    def make():
        def work(rows):
            out = []
            for doc_id, text in rows:
                spans = find(text)
                cells = [{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in spans]
                out.append((doc_id, cells, masked(text, spans)))
            return out
        return work

    return map_texts(docs.select(F.col(id_col), F.col(text_col)), make, SCHEMA, ARROW)


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with masked texts; ``n_chars``, where there, follows. Columns stay as they are."""
    def run(batches):
        for whole in batches:
            names = whole.schema.names
            at = names.index("text")
            for batch in slices(whole, at):
                texts = [masked(t, find(t)) for t in batch.column(at).to_pylist()]
                new = {"text": pa.array(texts, batch.schema.field("text").type)}
                if "n_chars" in names:
                    kind = batch.schema.field("n_chars").type
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], kind)
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


@query("op9_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE], F.size("spans").cast("bigint").alias("n_spans"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
