"""Secret scanning with structural confirmation.

Three plain patterns give the base spans (``assign``, ``access``, ``hex``).  A
second layer looks at encoded candidates and reports one only after its inside
has been read: the header and payload of a signed token must be JSON objects
with an algorithm, the nested lengths of a DER value must add up to its end, and
the fields of an OpenSSH key must fill it; an encrypted token needs a header that names both of its algorithms.
Longer base64 or hex runs are decoded and looked into for all of these, up to ``LAYERS`` encodings deep (``encoded``):
runs of the standard and of the URL alphabet apart, from each of the four places that an encoding can be in step with
(what stands before it may be of the same letters), and wrapped lines joined.  Every row is looked at on its own, so
the job is one narrow map: no shuffle, and any lost task is simply run again.

Defined results: a null or empty text has no spans; a row is never dropped or
cut; repeated rows give repeated results; further columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.storage import documents

#: In the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "hexder", "encoded", "jwe")
N_BASE = 3
LAYERS = 3
#: What a redacted span becomes.
MASK = "[SECRET]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Letters of tokens with their dots; the parts are read one by one.
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
_DER = re.compile(r"(?<![A-Za-z0-9+/])M[A-Za-z0-9+/]{39,}={0,2}")
_OPENSSH = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]+={0,2}")
_HEXDER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")

#: Runs of either alphabet, and lines of them that a mail or a configuration has wrapped.
_RUNS = (re.compile(r"[A-Za-z0-9+/]{48,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{48,}={0,2}"))
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/_-]{40,}+)*+"
    r"(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/_-]++={0,2}(?=[ \t]*+(?:\r?\n|\Z)))?+={0,2}"
)
_BETWEEN = re.compile(r"[\s>]+")
_SEPARATOR = re.compile(r"[+/_-]")
_HEX_RUN = re.compile(r"(?:[0-9A-Fa-f]{2})+")

_JSON = json.JSONDecoder()

Span = tuple[int, int, int]  # start, kind's number, end


def _decoded(text: str, urlsafe: bool = False) -> bytes:
    text = re.sub(r"\\n|\\r|\s", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def _json_object(data: bytes) -> dict:
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def der_is_whole(data: bytes, depth: int = 0) -> bool:
    """True if data is one run of tag-length-value items, and so is each constructed one, to its last byte."""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return False
        if tag in (0, 0xFF) or at + size > len(data):
            return False
        if tag & 0x20 and not der_is_whole(data[at : at + size], depth + 1):
            return False
        at += size
    return True


def is_key_sequence(data: bytes) -> bool:
    """A DER SEQUENCE over all of data that begins, as key encodings do, with an INTEGER or a SEQUENCE."""
    if len(data) < 24 or data[0] != 0x30 or not der_is_whole(data):
        return False
    first = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    return data[first] in (0x02, 0x30)


def is_openssh_key(data: bytes) -> bool:
    """The magic word, then length-prefixed fields that end where data ends."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at, fields = 15, []
    while len(fields) < 3:  # cipher, kdf, kdf options
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return False
        at += 4 + size
    return at == len(data)


def _header(part: str) -> tuple[int, dict]:
    """Where a JSON object begins that fills the rest of the part, and the object; it may stand behind other letters."""
    starts = [m.start() for m in re.finditer("eyJ", part)]
    for step in sorted({i % 4 for i in starts}):
        text = _in_step(part[step:]).decode("latin-1")
        for i in starts:
            if i % 4 == step:
                try:
                    found, end = _JSON.raw_decode(text, (i - step) // 4 * 3)
                except (ValueError, RecursionError):
                    continue
                if isinstance(found, dict) and end == len(text):
                    return i, found
    return 0, {}


def _tokens(run: str, start: int) -> list[Span]:
    """Signed and encrypted tokens among the dotted parts of a run."""
    spans, parts, at = [], run.split("."), start
    for i, part in enumerate(parts):
        if "eyJ" in part and i + 2 < len(parts):
            first, header = _header(part)
            if isinstance(header.get("alg"), str):
                if parts[i + 1].startswith("eyJ") and _json_object(_decoded(parts[i + 1], urlsafe=True)):
                    spans.append((at + first, 3, at + sum(map(len, parts[i : i + 3])) + 2))
                elif isinstance(header.get("enc"), str) and i + 4 < len(parts) and all(parts[i + 2 : i + 5]):
                    spans.append((at + first, 9, at + sum(map(len, parts[i : i + 5])) + 4))
        at += len(part) + 1
    return spans


def _confirmed(text: str) -> list[Span]:
    """Spans of encoded secrets whose inside has been read."""
    spans: list[Span] = []
    if "eyJ" in text:
        for m in _DOTTED.finditer(text):
            if "eyJ" in m[0]:
                spans += _tokens(m[0], m.start())
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = _decoded(m[2])
            if is_key_sequence(body) or is_openssh_key(body):
                spans.append((m.start(), 4, m.end()))
    spans += [(m.start(), 5, m.end()) for m in _DER.finditer(text) if is_key_sequence(_decoded(m[0]))]
    if "b3BlbnNzaC1rZXktdjEA" in text:
        spans += [(m.start(), 6, m.end()) for m in _OPENSSH.finditer(text) if is_openssh_key(_decoded(m[0]))]
    for m in _HEXDER.finditer(text):
        if len(m[0]) % 2 == 0 and is_key_sequence(bytes.fromhex(m[0])):
            spans.append((m.start(), 7, m.end()))
    return spans


def _bytes_hold(data: bytes, layers: int) -> bool:
    """Whether decoded bytes are or hold a confirmed secret."""
    inside = data.decode("latin-1")
    return bool(_confirmed(inside)) or (layers > 1 and bool(_encoded(inside, layers - 1)))


def _in_step(run: str) -> bytes:
    """What a run decodes to, without a last letter that belongs to no byte."""
    run = run.rstrip("=")
    return _decoded(run[:-1] if len(run) % 4 == 1 else run, urlsafe="-" in run or "_" in run)


def _begins_key(run: str, at: int) -> bool:
    """Whether a DER sequence over the rest of the run, or an OpenSSH key, may begin here."""
    if run.startswith("b3BlbnNzaC1rZXktdjEA", at):
        return True
    head = _decoded(run[at : at + 8], urlsafe=True) or _decoded(run[at : at + 8])
    if len(head) < 6 or head[0] != 0x30:
        return False
    extra = head[1] & 0x7F if head[1] >= 0x80 else 0
    size = int.from_bytes(head[2 : 2 + extra], "big") if extra else head[1]
    return extra <= 4 and 2 + extra + size == len(run[at:].rstrip("=")) * 3 // 4


def _holds_secret(run: str, layers: int) -> int | None:
    """From where on a base64 or hex run hides a confirmed secret."""
    if _HEX_RUN.fullmatch(run):
        data = bytes.fromhex(run)
        if is_openssh_key(data) or _bytes_hold(data, layers):
            return 0
    for step in range(4):
        data = _in_step(run[step:])
        if step == 0 and layers < LAYERS and is_openssh_key(data) or _bytes_hold(data, layers):
            after = next((m.end() for m in _SEPARATOR.finditer(run) if m.end() % 4 == step), None) if step else None
            return after if after is not None and _bytes_hold(_in_step(run[after:]), layers) else step
    for m in _SEPARATOR.finditer(run):
        if _begins_key(run, m.end()):
            data = _in_step(run[m.end() :])
            if is_key_sequence(data) or is_openssh_key(data):
                return m.end()
    return None


def _encoded(text: str, layers: int) -> list[Span]:
    """Spans of runs, and of wrapped lines, that hide a confirmed secret."""
    spans = set()
    for pattern in _RUNS:
        for m in pattern.finditer(text):
            at = _holds_secret(m[0], layers)
            if at is not None:
                spans.add((m.start() + at, 8, m.end()))
    for m in _WRAPPED.finditer(text):
        if "\n" in m[0] and _holds_secret(_BETWEEN.sub("", m[0]), layers) is not None:
            spans.add((m.start(), 8, m.end()))
    return sorted(spans)


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, by start and then kind; offsets are code points, ends exclusive."""
    if not text:
        return []
    spans: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans += _confirmed(text)
    spans += _encoded(text, LAYERS)
    return sorted(spans)


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by MASK."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, upto = [], 0, -1
    for start, _, end in spans:
        if start > upto:
            if upto >= 0:
                out.append(MASK)
                at = upto
            out.append(text[at:start])
        upto = max(upto, end)
    return "".join([*out, MASK, text[upto:]])


_SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "rank", "end")]))


@F.arrow_udf(_SPANS)
def _spans_of(texts: pa.Array) -> pa.Array:
    found = [[{"start": s, "rank": k, "end": e} for s, k, e in find_spans(t.as_py())] for t in texts]
    return pa.array(
        found, type=pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    )


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array) -> pa.Array:
    return pa.array([masked(t.as_py()) for t in texts], type=pa.string())


def secret_spans(text: Column) -> Column:
    """Array of (start, kind, end), sorted by start and then by the order of KINDS."""
    names = F.array(*map(F.lit, KINDS))
    return F.transform(
        _spans_of(text), lambda s: F.struct(s["start"], s["rank"], names[s["rank"]].alias("kind"), s["end"])
    )


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Every span of ``text`` replaced by MASK; other columns and the number of rows stay."""
    return df.withColumn(text, _masked(F.col(text)))


def _of_kind(spans: Column, rank: int) -> Column:
    """The spans of one kind; a second parameter of the lambda would be bound to the span's index."""
    return F.filter(spans, lambda s: s["rank"] == rank)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", secret_spans(F.col("text")).alias("found"))
    n_of = {k: F.size(_of_kind(F.col("found"), r)).cast("long") for r, k in enumerate(KINDS)}
    return found.select(
        "doc_id",
        *(n_of[k].alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(F.filter("found", lambda s: s["rank"] < N_BASE)), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )
