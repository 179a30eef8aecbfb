"""Secret scans by patterns and by dictionary-primed zstandard novelty.

Three patterns give the base spans: assignments to sensitive names, access
keys and long hexadecimal runs. The method adds spans: strings of key-like
characters up to ``REACH`` before or after a sensitive word, cut at the words
themselves, are candidates, and each is measured by the bytes that it adds to
the compressed ``AROUND`` characters on either side, with a dictionary of code
and identifiers. Nothing but this measure decides, on strings of letters or
digits alone too: a string that neither the dictionary nor its surroundings
explain, at ``NOVELTY`` bytes a character or more, is reported. One that a
base span holds whole needs no second one; one that reaches beyond it does.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run's one match, if it is long enough
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

CONTEXT = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|authorization|bearer|client[_ -]?id", re.IGNORECASE | re.ASCII)
_CONTEXT_PARTS = ("passw", "passphrase", "secret", "token", "key", "credential", "authorization", "bearer", "client")
#: Code points between a sensitive word and a candidate, and around it for its surroundings.
REACH, AROUND = 48, 1500
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
NOVELTY = 0.6
#: Parts of names and long words, which are added as they are and with a capital.
_WORDS = (
    "abstract access account action adapter address application argument array async attribute authentication background base bean before buffer builder button bytes cache call center change char "
    "character check child class client collection column command comment common component condition connection container content convert count create credential current custom data date decode default "
    "definition description detail dialog direction directory document domain element encode entity entry error event exception execute expression extension external factory field filter format "
    "generate global group helper history image index information input instance integer interface internal international item iterator language layout length library listener location logger management map memory "
    "message method module name network notification number object operation option output package panel parameter parent parser password path pattern permission plugin pool position process "
    "product profile project property proxy public query reader receive record reference register remove render request resource resolver response result return role schedule schema script section segment "
    "select serialize sequence setting single singleton source standard start state statement status storage stream string structure style subject support symbol table target template test "
    "thread time transaction transform translate type update upload user util validate validator value vector version view visible widget window wrapper write "
    "under over inter counter trans super pre post non anti multi micro hyper mis dis self semi able ability ation ational ization isation istic istically ingly iously fully less ness ment ments ship "
    "responsib compat understand standing national revolution represent communicat administrat gesellschaft schaft keit heit ung ungen lich begrenzung geschwindig verwaltung iones amiento mente idad aciones ement"
).split()
_DICTIONARY = (
    "abcdefghijklmnopqrstuvwxyz0123456789 example changeme placeholder your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 "
    "import from return class def function const let var public private static void int string bool float double null true false None True False self this "
    "getElementById addEventListener createElement querySelector JSON.stringify JSON.parse Object.keys console.log System.out.println "
    "user_name username password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer credential "
    "config settings environment variable process.env os.environ application/json text/html charset=utf-8 http:// https:// www. .com .org .net localhost 127.0.0.1 "
    "connection database server host port session request response header cookie account service manager controller handler factory provider repository "
    "getInstance toString equals hashCode initialize update delete insert select where order group "
    "the and that with this from have which their would there about other "
).encode() * 2 + " ".join([*_WORDS, *map(str.capitalize, _WORDS)]).encode()


class Novelty:
    """Marginal compressed bytes of a string against text around it."""

    def __init__(self) -> None:
        import zstandard

        self._c = zstandard.ZstdCompressor(level=4, dict_data=zstandard.ZstdCompressionDict(_DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (before + after).encode("utf-8", "replace")
        cost = len(self._c.compress(around + candidate.encode())) - len(self._c.compress(around))
        return cost / len(candidate)


_novelty: list[Novelty] = []


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings of key-like characters within ``REACH`` of a sensitive word.

    Runs are split at the words themselves, so that pieces never overlap and
    the work is linear in the text.
    """
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return
    starts = [a for a, _ in words]
    for run in CANDIDATE.finditer(text):
        a, b = run.span()
        k = bisect_left(starts, a)
        if k and words[k - 1][1] > a:
            a = min(b, words[k - 1][1])  # a word with a blank in it reaches into the run
        while a < b:
            end = min(b, starts[k]) if k < len(words) else b
            near = k and a - words[k - 1][1] <= REACH or k < len(words) and starts[k] - end <= REACH
            if near and end - a >= LEAST:
                yield a, end
            if end == b:
                break
            a, k = words[k][1], k + 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by start, then kind."""
    low = text.lower()
    spans: list[tuple[str, int, int]] = []
    if any(n in low for n in _NAMES):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(p in low for p in _CONTEXT_PARTS):
        if not _novelty:
            _novelty.append(Novelty())
        base = sorted((s, e) for _, s, e in spans)
        starts = [s for s, _ in base]
        reach = list(accumulate((e for _, e in base), max))
        for start, end in _candidates(text):
            k = bisect_right(starts, start)
            if k and reach[k - 1] >= end:
                continue  # a base span says as much
            if _novelty[0](text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]) >= NOVELTY:
                spans.append(("novel", start, end))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by [kind], overlapping spans by the first's."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def _scanner(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = find_spans(text or "")
                base = [s for s in spans if s[0] != "novel"]
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(spans), redact(text, spans) if with_text and text is not None else None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            found = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if with_text:
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found[:-1]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    spans has kind:start:end of all spans, comma-joined, in code points with
    the end exclusive; base_sha256 is the digest of the base spans alone. Null
    texts count as empty and have no spans. Repeated rows and null ids each
    give their row; other columns are ignored; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scanner(False), SCHEMA.rsplit(", ", 1)[0])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in ``text`` replaced by its kind in brackets and
    ``n_chars``, where there is one, set to the new length. Null texts stay."""
    text_batches(docs.sparkSession)
    inner = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = T._parse_datatype_string(SCHEMA.split(", ", 1)[1])
    out = inner.mapInArrow(_scanner(True), T.StructType([*inner.schema.fields, *found.fields]))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("redacted").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.char_length("redacted")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
