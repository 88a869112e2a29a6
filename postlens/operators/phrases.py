"""Names of any number and length found in one pass per text, by an automaton over words.

The automaton is a tree of the names' words with, per node, the node of its longest proper
ending (the failure link) and the names that end there. It is built once on the driver from
a list whose size is checked, and sent to the tasks as one broadcast; the plan that uses it
holds no name.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?]+[.!?]*")

NAMES = 200_000
NAME_CHARS = 16_000_000
PART_ROWS = 512  # texts whose results are held at once


class Automaton:
    """Which names end at a word, read from left to right; time follows the words and hits, not the names."""

    def __init__(self, names: Sequence[tuple[str, str]]):
        """``names`` are (words parted by one blank, kind)."""
        self.steps: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.names: list[tuple[tuple[int, str, str], ...]] = [()]
        for phrase, kind in names:
            at, words = 0, phrase.split(" ")
            for word in words:
                known = self.steps[at].get(word)
                if known is None:
                    known = self.steps[at][word] = len(self.steps)
                    self.steps.append({})
                    self.fail.append(0)
                    self.names.append(())
                at = known
            self.names[at] += ((len(words), phrase, kind),)
        waiting = deque(self.steps[0].values())
        while waiting:
            node = waiting.popleft()
            for word, child in self.steps[node].items():
                waiting.append(child)
                back = self.fail[node]
                while back and word not in self.steps[back]:
                    back = self.fail[back]
                self.fail[child] = self.steps[back].get(word, 0)
                # what ends at the shorter ending ends here too; it is nearer the root, so complete
                self.names[child] += self.names[self.fail[child]]

    def hits(self, words: Sequence[str]) -> list[tuple[int, str, str, int]]:
        """``(first word, phrase, kind, last word)`` of every name, in reading order."""
        steps, fail, names, found, at = self.steps, self.fail, self.names, [], 0
        for i, word in enumerate(words):
            while True:
                follow = steps[at].get(word)
                if follow is not None:
                    at = follow
                    break
                if not at:
                    break
                at = fail[at]
            for size, phrase, kind in names[at]:
                found.append((i - size + 1, phrase, kind, i))
        found.sort()
        return found


@dataclass(frozen=True)
class Names:
    """The automaton as sent to the tasks."""

    sent: Broadcast


def listed_names(names: DataFrame, limit: int = NAMES, chars: int = NAME_CHARS) -> Names | None:
    """The automaton of distinct ``(phrase, kind)``, or None for a list beyond ``limit`` names or ``chars``.

    The sizes are asked for before a row is fetched.
    """
    size = names.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("c")).first()
    if size["n"] > limit or size["c"] > chars:
        return None
    rows = sorted((r["phrase"], r["kind"]) for r in names.collect())
    return Names(names.sparkSession.sparkContext.broadcast(Automaton(rows)))


def _over_texts(kind: str, found: Callable[[str, Automaton], object], type_: pa.DataType, names: Names) -> Callable[[Column], Column]:
    sent = names.sent

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = sent.value
        for batch in batches:
            for at in range(0, len(batch), PART_ROWS):
                yield pa.array([found(text.as_py() or "", automaton) for text in batch.slice(at, PART_ROWS)], type_)

    return run


def names_in_text(text: Column, names: Names, kinds: Sequence[str]) -> Column:
    """A struct with the names of each kind, in reading order."""
    def found(text: str, automaton: Automaton) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {k: [] for k in kinds}
        for _, phrase, kind, _ in automaton.hits(WORD.findall(text)):
            if kind in out:
                out[kind].append(phrase)
        return out

    shape = pa.struct([(k, pa.list_(pa.string())) for k in kinds])
    return _over_texts("struct<" + ", ".join(f"{k}: array<string>" for k in kinds) + ">", found, shape, names)(text)


def naming_sentences(text: Column, names: Names, pattern: str, limit: int, blank: str) -> Column:
    """The first ``limit`` stripped sentences that hold a name or match ``pattern``."""
    matched = re.compile(pattern, re.ASCII)

    def found(text: str, automaton: Automaton) -> list[str]:
        out: list[str] = []
        for one in SENTENCE.finditer(text):
            sentence = one.group().strip(blank)
            if sentence and (matched.search(sentence) or automaton.hits(WORD.findall(sentence))):
                out.append(sentence)
                if len(out) == limit:
                    break
        return out

    return _over_texts("array<string>", found, pa.list_(pa.string()), names)(text)
