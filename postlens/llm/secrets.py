"""Secret scans: three fixed patterns, and random strings by their characters per token.

A vocabulary learned from text spends few tokens on words and many on random strings,
so a candidate with few characters per token is random. Known digests and identifiers
are excluded first. One map over whole texts, no shuffle.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from postlens.llm.words import few_rows

# fixed by the contract of the scan; kinds in the order in which equal starts are listed
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    # runs are maximal, so the minimum can stand in the pattern and short runs cost nothing
    ("hex", re.compile(r"[0-9a-f]{24,}")),
)
KINDS = [kind for kind, _ in BASE] + ["random"]

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # maximal runs
SEGMENT = re.compile(r"[^/]{20,}")
HOST = re.compile(r"(?:://(?:[^\s/?#@]*@)?|@)([A-Za-z0-9.-]+)")
DIGEST = re.compile(r"[0-9a-fA-F]+\Z")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
IDENTIFIERS = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]+"  # numbers, dates and rules
)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns."""
    found = []
    for number, (kind, pattern) in enumerate(BASE):
        for match in pattern.finditer(text):
            size = len(match.group(2)) if kind == "assign" else match.end() - match.start()
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((match.start(), number, match.end()))
    return sorted(found)


def is_random(run: str, codec: tiktoken.Encoding, max_ratio: float) -> bool:
    """Whether a token is spent on every few characters; capitals may also be read as small letters.

    Digests, identifiers and rules of one or two characters are not.
    """
    if DIGEST.match(run) and len(run) in DIGEST_LENGTHS or IDENTIFIERS.fullmatch(run) or len(set(run)) < 3:
        return False
    forms = [run, run.lower()] if run.isupper() else [run]
    return all(len(run) <= max_ratio * len(codec.encode_ordinary(form)) for form in forms)


def random_spans(text: str, codec: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    """Candidates spending a token on every few characters.

    A run is decided whole, or else by its segments between slashes; after a dot or in
    an address (``://``) only by these. Host names are no candidates.
    """
    found, hosts, starts = [], None, []
    for match in CANDIDATE.finditer(text):
        start, run = match.start(), match.group()
        if hosts is None:
            hosts = [m.span(1) for m in HOST.finditer(text)]
            starts = [a for a, _ in hosts]
        address = run.startswith("//") or "/" in run and text[start - 1:start] == "."
        spans = [] if address else [(start, match.end())]
        if "/" in run:
            spans += [(start + m.start(), start + m.end()) for m in SEGMENT.finditer(run)]
        for one, end in spans:
            host = bisect_right(starts, one) - 1  # the last that starts no later
            if found and one < found[-1][2] or host >= 0 and end <= hosts[host][1]:
                continue
            if is_random(text[one:end], codec, max_ratio):
                found.append((one, len(BASE), end))
    return found


REST = 12


def scan(text: str, codec: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    """All spans by start, then kind; of a random string that meets base spans, what lies outside of them.

    Both lists are sorted and read side by side. The rest of such a string counts if its
    parts, put together, are at least ``REST`` characters and random too.
    """
    base = base_spans(text)
    covered: list[list[int]] = []  # the base spans, those that touch or overlap as one
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    extra, at = [], 0
    for start, kind, end in random_spans(text, codec, max_ratio):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        rest, place, k = [], start, at
        while k < len(covered) and covered[k][0] < end:
            rest.append((place, kind, max(place, covered[k][0])))
            place, k = covered[k][1], k + 1
        if k == at:
            extra.append((start, kind, end))
            continue
        rest = [r for r in [*rest, (place, kind, end)] if r[0] < r[2]]
        joined = "".join(text[a:b] for a, _, b in rest)
        if len(joined) >= REST and is_random(joined, codec, max_ratio):
            extra += rest
    return sorted(base + extra)


def find_secrets(docs: DataFrame, vocabulary: str, text_col: str = "text", max_ratio: float = 2.1,
                 out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: an array of (kind, start, end) in code points, end exclusive.

    ``vocabulary`` is a tiktoken rank file. Null and empty texts hold no secret; long
    texts are scanned whole. Rows are scanned alone, so repeated rows agree and an
    empty table stays empty; an input column named ``out_col`` is replaced.
    """
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = encoding(vocabulary)
        for batch in batches:
            found = [scan(text or "", codec, max_ratio) for text in batch.to_pylist()]
            yield pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found], shape)

    return few_rows(docs).withColumn(out_col, spans(F.col(text_col)))


def redact(docs: DataFrame, vocabulary: str, text_col: str = "text", mask: str = "[SECRET]",
           max_ratio: float = 2.1) -> DataFrame:
    """``docs`` with every span found replaced by ``mask``; overlapping spans become one.

    No row is dropped. Null texts stay null, texts without secrets stay as they are.
    """
    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = encoding(vocabulary)
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                parts, at = [], 0
                for start, _, end in scan(text or "", codec, max_ratio):
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.array(out, pa.string())

    return few_rows(docs).withColumn(text_col, masked(F.col(text_col)))
