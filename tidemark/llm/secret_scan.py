"""Secret scan: fixed credential patterns, and high-entropy windows inside candidate strings.

A candidate is a maximal run of at least ``shortest`` characters that keys are written in; it is judged whole and, if it
holds '=', '-', '_', '/' or '+', by its stretches of letters and digits too, each by the limit of its own class, so that
what a key is glued to does not raise its limit. A window slides over it (below ``window`` characters, one window); the
counts of its characters change by one in and one out, and with them sum(c log2 c), from which the Shannon entropy
follows. Windows whose entropy exceeds the limit of the candidate's character class form spans, unless the allow-list
knows the candidate, the window meets a series or placeholder, less than half of it lies outside the word-like segments
of a path, or it is all letters or all digits. Spans that a base match covers are not added.

Cases: a null text is empty (no spans); empty texts and tables give no spans and no rows; every repeated row gets its
own row; a null doc_id is carried; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

KINDS = ("assign", "access", "hex", "entropy")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + (
    _either_case("api") + "_?" + _either_case("key"))
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs shorter than 16 are dropped anyway, and a run's match is the whole run.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
_HINTS = ("passw", "secret", "token", "key")


@dataclass(frozen=True)
class EntropyPolicy:
    window: int = 20
    #: Runs from here to the window's length are judged as one window.
    shortest: int = 16
    #: Bits a character, by class of the candidate; a window of 20 different characters has 4.32.
    limits: dict = field(default_factory=lambda: {"hex": 3.1, "alnum": 3.6, "base64": 3.8})
    #: Candidates never reported: identifiers, one character, rules.
    allow: tuple[str, ...] = (r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"(.)\1*", r"[=_-]+.*[=_-]{8,}")
    #: Series and placeholders: windows that overlap one are not reported, the rest of the candidate is judged.
    marks: str = r"0123456789|abcdefghij|ABCDEFGHIJ|[Ee]xample|EXAMPLE|placeholder|x{4,}|X{4,}"
    #: Paths, and their segments that are words (camel case, joined by - or _, with up to four digits behind).
    path: str = r"[/A-Za-z_-]*/[/A-Za-z0-9_-]*/[/A-Za-z0-9_-]*"
    word: str = "{0}(?:[_-]+{0})*".format(r"(?:[A-Z]+|[A-Z][a-z]|[a-z]*(?:[A-Z][a-z]{2,})*)[0-9]{0,4}")


_XLOG = [0.0, *(c * log2(c) for c in range(1, 4097))]


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, policy: EntropyPolicy = EntropyPolicy(),
                  quiet: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Maximal stretches of s covered by windows above the limit of its class; windows that are quiet do not count."""
    w, limit = min(policy.window, max(len(s), policy.shortest)), policy.limits[char_class(s)]
    counts: dict[str, int] = {}
    total, letters, digits = 0.0, 0, 0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _XLOG[n + 1] - _XLOG[n]
        counts[c] = n + 1
        letters += c.isalpha()
        digits += c.isdigit()
        if i >= w:
            out = s[i - w]
            n = counts[out]
            total += _XLOG[n - 1] - _XLOG[n]
            counts[out] = n - 1
            letters -= out.isalpha()
            digits -= out.isdigit()
        if i >= w - 1 and letters and digits and log2(w) - total / w > limit and not (
                quiet and quiet(i - w + 1, i + 1)):
            if spans and i - w + 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - w + 1, i + 1))
    return spans


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places in spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the fixed patterns, code points."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


class Scanner:
    def __init__(self, policy: EntropyPolicy = EntropyPolicy()):
        self.policy = policy
        self.candidate = re.compile(CANDIDATE % policy.shortest)
        self.stretch = re.compile("[A-Za-z0-9]{%d,}" % policy.shortest)
        self.allow = [re.compile(p) for p in policy.allow]  # one by one: each has its own groups
        self.marks, self.path, self.word = re.compile(policy.marks), re.compile(policy.path), re.compile(policy.word)

    def quiet(self, s: str) -> Callable[[int, int], bool] | None:
        """Whether the window [a, b) of s is not to be reported; None if any may be."""
        marks = [m.span() for m in self.marks.finditer(s)]
        odd = None
        if self.path.fullmatch(s):
            odd = [0]
            for part in re.split("(/)", s):
                odd += [0 if part == "/" or self.word.fullmatch(part) else 1] * len(part)
            odd = list(accumulate(odd))
        if not marks and odd is None:
            return None
        return lambda a, b: any(a < y and x < b for x, y in marks) or (odd is not None and 2 * (odd[b] - odd[a]) < b - a)

    def allowed(self, s: str) -> bool:
        return any(p.fullmatch(s) for p in self.allow)

    def scan(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans."""
        base = base_spans(text)
        starts, upto = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
        extra = []
        for m in self.candidate.finditer(text):
            s = m[0]
            if s.isalpha() or s.isdigit() or self.allowed(s):
                continue
            quiet = self.quiet(s)
            found = entropy_spans(s, self.policy, quiet)
            for part in self.stretch.finditer(s):
                if part[0] != s and not self.allowed(part[0]):
                    at = part.start()
                    inner = quiet and (lambda a, b, at=at: quiet(a + at, b + at))
                    found += [(a + at, b + at) for a, b in entropy_spans(part[0], self.policy, inner)]
            for a, b in united(found):
                a, b = a + m.start(), b + m.start()
                k = bisect_right(starts, a)
                if not k or upto[k - 1] < b:
                    extra.append((a, b, 3))
        return base, sorted(base + extra, key=lambda x: (x[0], x[2]))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan(docs: DataFrame, policy: EntropyPolicy = EntropyPolicy()) -> DataFrame:
    """One row per document with its spans; a map over the table without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(policy)
        for batch in batches:
            n, digest, spans = [[], [], [], []], [], []
            for x in batch.column(1):
                base, every = scanner.scan(x.as_py() or "")
                for k in range(4):
                    n[k].append(sum(s[2] == k for s in every))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string()), pa.array(n[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return C.input_columns(docs, "doc_id", "text").mapInArrow(run, _OUT)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
