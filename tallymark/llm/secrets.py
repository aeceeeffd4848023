"""Secret scan: three fixed patterns plus sliding-window Shannon entropy.

Candidate strings are runs of one character class.  A window slides over a candidate;
its symbol counts are updated by the symbol that enters and the one that leaves, so a
step costs the same for any window.  Windows above the class's threshold are merged into
spans.  Candidates on the allow-list give none.

Defined cases: a null text counts as empty; rows stay separate, whatever their id; other
columns are ignored; a very long text or candidate is scanned whole, in time in proportion
to it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Character class: candidate pattern, window and bits a character that a secret exceeds.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Za-z+/_-])[0-9A-Fa-f]{16,}(?![0-9A-Za-z+/_-])"), 16, 2.9),
    "entropy_base64": (re.compile(r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{24,}={0,2}"), 24, 3.9),
}
#: A whole candidate that matches is no secret: numbers, words, UUIDs, paths of words.
ALLOW = re.compile(r"[0-9]+|[A-Za-z/_+-]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def entropy_runs(text: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged windows of ``text`` with more than ``threshold`` bits a character."""
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        if i >= window and char != text[i - window]:
            gone = text[i - window]
            g = counts[gone]
            total += cost[g - 1] - cost[g] + cost[c + 1] - cost[c]
            counts[gone], counts[char] = g - 1, c + 1
        elif i < window:
            total += cost[c + 1] - cost[c]
            counts[char] = c + 1
        if i >= window - 1 and math.log2(window) - total / window > threshold:
            if runs and runs[-1][1] >= i - window + 1:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i - window + 1, i + 1))
    return runs


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    spans = []
    for kind, (pattern, window, threshold) in CLASSES.items():
        for m in pattern.finditer(text):
            if not ALLOW.fullmatch(m[0]):
                spans += [(m.start() + a, KINDS.index(kind), m.start() + b) for a, b in entropy_runs(m[0], window, threshold)]
    return spans


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans) -> str:
    """Replace each maximal run of overlapping spans by ``[SECRET]``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(batches, names: list[str], with_text: bool):
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = base + entropy_spans(text)
            counts = [sum(k == n for _, k, _ in base) for n in range(3)]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redact(text, spans) if with_text and spans else None))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 3, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Return ``id_col``, n_assign, n_access, n_hex, base_sha256, spans and redacted.

    ``redacted`` is the text without its secrets, null where nothing was found or
    ``with_text`` is not set.
    """
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
    source = docs.select(id_col, F.col(text_col).cast("string"))
    schema = T.StructType([source.schema[0], *(T.StructField(n, T.LongType()) for n in names[1:4]), *(T.StructField(n, T.StringType()) for n in names[4:])])
    return source.mapInArrow(lambda it: _scan(it, names, with_text), schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with secrets replaced in ``text_col``."""
    place = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            texts = [t if not t or not (s := base_spans(t) + entropy_spans(t)) else redact(t, s) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(clean, docs.schema)
