"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base spans (code points, end exclusive) are the leftmost non-overlapping matches of each kind. The
method adds ``entropy`` spans: every maximal run of ``[A-Za-z0-9+/_=-]`` of ``min_length`` or more
characters is a candidate; the Shannon entropy of a window of ``window`` characters is kept by
incremental counts while it slides, separately for each character class (hexadecimal, lower and upper
case letters with digits, base64), and a candidate is a secret where a window reaches the threshold of
its class. Candidates that look like ordinary text are suppressed by an allow-list: no digit at all,
dashed words, dates and identifiers such as UUIDs, or a listed example key.

A candidate that overlaps base spans is a secret or none as a whole; what of it lies outside those spans is
added piece by piece, but for a short piece before an assignment, which is the start of a name.

Defined cases: null and empty texts have no spans; a candidate inside a base span is not added again; spans
are ordered by start, then by kind as listed (ties by end); repeated rows give equal rows, null ids stay
null, an empty table gives an empty result; other columns are ignored by ``report`` and kept by ``redact``.
Time and memory grow with the length of a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
MIN_LENGTH = 20
#: Bits per character that a window of each class must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of one class are maximal, so a run that is too short holds no other match that is long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Strings that look like secrets and are none.
ALLOWED = re.compile(
    r"[^0-9]*"  # no digit: words, however long
    r"|[0-9_=+/-]*"  # no letter: numbers, dates, rules
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[A-Za-z0-9_]*(?:example|EXAMPLE|dummy|placeholder|xxxx|XXXX)[A-Za-z0-9_]*"
    r"|[a-z]+(?:[-_/][a-z0-9]{1,12})+"  # slugs and paths
    r"|[a-z0-9]+(?:[-_/][a-z]+)+"
)
_LOGS = [0.0] + [n * math.log2(n) for n in range(1, 4097)]


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def max_window_entropy(s: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy of ``window`` consecutive characters, by incremental counts."""
    n = min(window, len(s))
    if not n:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c); entropy = log2(n) - total / n
    best = math.inf
    logs = _LOGS
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += logs[k + 1] - logs[k]
        counts[c] = k + 1
        if i >= n:
            old = s[i - n]
            k = counts[old]
            total -= logs[k] - logs[k - 1]
            counts[old] = k - 1
        if i >= n - 1 and total < best:
            best = total
    return math.log2(n) - best / n


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), ordered."""
    if not text:
        return []
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted((a, b, kind) for a, b, kind in spans)
    at = 0  # base spans before this one end before the candidate
    for m in CANDIDATE.finditer(text):
        lo, hi = m.span()
        while at < len(base) and base[at][1] <= lo:
            at += 1
        if ALLOWED.fullmatch(m[0]) or max_window_entropy(m[0]) < THRESHOLDS[character_class(m[0])]:
            continue
        k = at
        while k < len(base) and base[k][0] < hi:
            a, b, kind = base[k]
            if lo < a and (kind != "assign" or a - lo >= MIN_LENGTH):
                spans.append((lo, a, "entropy"))
            lo = max(lo, b)
            k += 1
        if lo < hi:
            spans.append((lo, hi, "entropy"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _join(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lo in range(0, part.num_rows, 512):
                piece = part.slice(lo, 512)
                rows = []
                for text in piece.column("text"):
                    spans = scan(text.as_py())
                    n = {k: sum(s[2] == k for s in spans) for k in KINDS}
                    own = _join(s for s in spans if s[2] != "entropy")
                    digest = hashlib.sha256(own.encode()).hexdigest()
                    rows.append((n["assign"], n["access"], n["hex"], digest, _join(spans), n["entropy"]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(c) for c in zip(*rows))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
                )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        run,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long",
    )


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each run of overlapping spans replaced by ``mark``; all else is kept."""

    def run(batches):
        for part in batches:
            k = part.schema.get_field_index(text_col)
            texts = []
            for value in part.column(k):
                text = value.as_py()
                spans = scan(text)
                if spans:
                    kept, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            kept += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join([*kept, text[at:]])
                texts.append(text)
            arrays = [pa.array(texts, part.schema.field(k).type) if j == k else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
