"""Secret scans: strong patterns, and multipart credentials linked within scopes.

Strong spans are reported as they stand. A weak part - a short assigned value, a key-like
string, a name that logs in, a short access id, an address - is reported only where its
complements stand near it in the same paragraph: a secret needs an identifier or an
endpoint, an identifier a secret, an endpoint both. Parts are joined as intervals over all
documents of an Arrow batch at once: two counts of sorted ends and starts per candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, table

#: Fixed values of the strong patterns: pattern and least length.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGNED, ACCESS_LENGTH = 12, 18
#: Weak parts: a shorter assigned value, forty characters of a key, a shorter access id.
WEAK_ASSIGNED, WEAK_ACCESS = 8, 12
KEY = re.compile(rb"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])")
LOGIN = re.compile(rb"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""")
ADDRESS = re.compile(
    rb"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>`\x7f]+"""
    rb"""|(?<![A-Za-z0-9])(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?"""
)
BREAK = re.compile(rb"\n[\x20\t\r]*\n")
#: Code points between two parts of one credential.
REACH = 200

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
STRONG = 3
SECRETS, IDENTIFIERS, ENDPOINTS = (0, 2, 3), (1, 4), (5,)


def parts_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the strong spans and of all weak candidates."""
    found = []
    for m in ASSIGN.finditer(raw):
        size = m.end(2) - m.start(2)
        if size >= WEAK_ASSIGNED:
            found.append((0 if size >= ASSIGNED else 3, *m.span()))
    if b"AKIA" in raw:
        for m in ACCESS.finditer(raw):
            if m.end() - m.start() >= WEAK_ACCESS:
                found.append((1 if m.end() - m.start() >= ACCESS_LENGTH else 4, *m.span()))
    found.extend((2, *m.span()) for m in HEX.finditer(raw))
    for m in KEY.finditer(raw):
        own = m.group()
        if not own.isalpha() and own.lower() != own and own.upper() != own:
            found.append((3, *m.span()))
    found.extend((4, *m.span()) for m in LOGIN.finditer(raw))
    if b"://" in raw or b"host" in raw.lower() or b"server" in raw.lower() or b"endpoint" in raw.lower():
        found.extend((5, *m.span()) for m in ADDRESS.finditer(raw))
    return found


def near(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray, reach: int) -> np.ndarray:
    """Whether some other interval lies beside [start, end) within reach, not overlapping it."""
    starts, ends = np.sort(other_start), np.sort(other_end)
    after = np.searchsorted(starts, end + reach, side="right") - np.searchsorted(starts, end, side="left")
    ahead = np.searchsorted(ends, start, side="right") - np.searchsorted(ends, start - reach, side="left")
    return after + ahead > 0


def linked(kind: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Which parts are reported; places are global, scopes lie further apart than `reach`."""
    of = {role: np.isin(kind, kinds) for role, kinds in (("secret", SECRETS), ("identifier", IDENTIFIERS), ("endpoint", ENDPOINTS))}
    beside = {role: near(start, end, start[own], end[own], reach) for role, own in of.items()}
    return (
        (kind < STRONG)
        | ((kind == 3) & (beside["identifier"] | beside["endpoint"]))
        | ((kind == 4) & beside["secret"])
        | ((kind == 5) & beside["secret"] & beside["identifier"])
    )


def scan_texts(texts: list[bytes | None], reach: int = REACH) -> list[list[tuple[int, int, int]]]:
    """Per text the reported (kind number, start, end) in code points, by start, then kind."""
    who, kinds, starts, ends, places = [], [], [], [], []
    base = 0
    for k, raw in enumerate(texts):
        found = parts_of(raw) if raw else []
        if not found:
            continue
        kind, start, end = (np.array(x, dtype=np.int64) for x in zip(*found))
        scope = np.searchsorted(np.array([m.start() for m in BREAK.finditer(raw)], dtype=np.int64), start)
        if not raw.isascii():  # spans start and end at whole characters
            cuts = np.unique(np.concatenate([start, end]))
            size = [len(raw[a:b].decode()) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            place = np.cumsum(size)
            start, end = place[np.searchsorted(cuts, start)], place[np.searchsorted(cuts, end)]
        own = base + scope * (2 * reach + 2)
        who.append(np.full(len(kind), k))
        kinds.append(kind)
        starts.append(start)
        ends.append(end)
        places.append(own)
        base = int((own + end).max()) + 2 * reach + 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not who:
        return out
    owner, kind, start, end, place = (np.concatenate(x) for x in (who, kinds, starts, ends, places))
    keep = linked(kind, start + place, end + place, reach)
    order = np.lexsort((end, kind, start, owner))
    for k in order[keep[order]].tolist():
        out[owner[k]].append((int(kind[k]), int(start[k]), int(end[k])))
    return out


def find_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every document's spans (kind, start, end) in code points, by start, then kind.

    Kinds are assign, access and hex (strong), secret, identifier and endpoint (weak, linked).
    Null and empty texts have no spans; texts of any length are scanned whole; repeated
    rows are scanned each; equal spans of one kind are reported once for each pattern that
    finds them. An empty table gives an empty result; other columns are not read.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    kind = chosen.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = scan_texts(part.column(1).cast(pa.binary()).to_pylist(), reach)
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], [id_col, "spans"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op13_linked_secrets")
def op13(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    strong = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:STRONG]))
    return found.select("doc_id", *map(_count, KINDS[:STRONG]), F.sha2(_joined(strong), 256).alias("base_sha256"), _joined("spans").alias("spans"))
