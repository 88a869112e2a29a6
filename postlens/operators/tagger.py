"""A tagger of names: averaged structured perceptron with Viterbi decoding over word features.

It learns from texts in which a gazetteer marks the names, and then finds names by their
form and neighbours, listed or not. Training mixes parameters: in every epoch each task
starts from the mixed weights, learns on its own sentences, and the tasks' weights are
averaged in a tree. The tagger has the average over the steps of the last epoch, when the
first, wild steps are past. Every text is learned from. Weights have a fixed size; sentences
are written once in blocks and read a block at a time, so a task's memory does not follow its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.operators.mentions import KINDS, names_of
from postlens.operators.phrases import SENTENCE, WORD, Automaton, Names, listed_names
from postlens.operators.sums import SUMS, part_sum, tree_sum
from postlens.session import written

TAGS = ("O", *[f"{place}-{kind}" for kind in KINDS for place in "BI"])
FORBIDDEN = -1e9
BATCH = 8
LOOK_AHEAD = 128  # most batches decoded at once while none is wrong
TASK_TEXTS = 2_000  # texts marked or tagged by one task
BLOCK_WORDS = 50_000  # words marked, learned from or tagged at once
WIDTH = 8  # buckets of a word
BLOCK = pa.schema([("rows", pa.binary()), ("ids", pa.binary()), ("ends", pa.binary()), ("tags", pa.binary())])


@dataclass(frozen=True)
class Learning:
    """Settings; all texts are learned from unless a caller asks for ``sample_rows``, those of smallest key hash."""

    buckets: int = 1 << 14
    epochs: int = 4
    sample_rows: int | None = None


@dataclass(frozen=True)
class Tagger:
    """Weights by feature bucket and tag, and by tag and following tag (first row: the start)."""

    emission: np.ndarray
    transition: np.ndarray


def follows() -> np.ndarray:
    """Which tags may follow: an inner tag only after one of its own kind."""
    table = np.zeros((len(TAGS) + 1, len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag.startswith("I-"):
            for i, before in enumerate(("", *TAGS)):
                if before[2:] != tag[2:]:
                    table[i, j] = FORBIDDEN
    return table


class Features(dict):
    """Buckets of a word: of its own, as the word before, as the word after."""

    def __init__(self, buckets: int, limit: int = 1 << 17):
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: str) -> tuple[list[int], int, int]:
        low = word.lower()
        shape = "".join("X" if c.isupper() else "d" if c.isdigit() else "x" for c in word[:1]) + ("1" if len(word) == 1 else "")
        shape += "U" if word.isupper() else "L" if word.islower() else "M"
        bucket = lambda name: zlib.crc32(name.encode()) % self.buckets
        own = [bucket(n) for n in ("bias", f"w={word}", f"l={low}", f"s={shape}", f"p={low[:3]}", f"e={low[-3:]}")]
        value = own, bucket(f"b={low}"), bucket(f"a={low}")
        if len(self) < self.limit:
            self[word] = value
        return value

    def table(self, sentences: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the start, the end and every distinct word, the words' places there, and where sentences end."""
        place: dict[str, int] = {}
        ids = np.array([place.setdefault(w, len(place)) for words in sentences for w in words], np.int32) + 2
        rows = np.array([(*own, before, after) for own, before, after in map(self.__getitem__, ("<start>", "<end>", *place))], np.int32)
        return rows, ids, np.cumsum([len(words) for words in sentences], dtype=np.int32)


def spread(rows: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of buckets per word, from ``Features.table``; no sentence is empty."""
    before, after = np.empty_like(ids), np.empty_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[np.concatenate([[0], ends[:-1]])], after[ends - 1] = 0, 1
    return np.concatenate([rows[ids, :-2], rows[before, -2:-1], rows[after, -1:]], 1)


def in_blocks(texts: Iterable[str | None]) -> Iterator[list[list[list[str]]]]:
    """The sentences of whole texts, of about ``BLOCK_WORDS`` words together; none is empty."""
    part, size = [], 0
    for text in texts:
        part.append([w for w in (WORD.findall(m.group()) for m in SENTENCE.finditer(text or "")) if w])
        size += sum(map(len, part[-1]))
        if size >= BLOCK_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _by_length(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences, the longest first, and how many of them have a word at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")


def viterbi(emissions: Sequence[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """The tags of greatest total score of each sentence; many sentences step together."""
    sizes = np.array([len(e) for e in emissions])
    if not sizes.any():
        return [np.empty(0, np.int64) for _ in emissions]
    flat, starts = np.concatenate(emissions), np.cumsum(sizes) - sizes
    order, live = _by_length(sizes)
    order = order[:live[0]]
    first, score = starts[order], transition[0] + flat[starts[order]]
    back = np.empty(flat.shape, np.int8)
    for step, n in enumerate(live[1:], 1):
        paths = score[:n, :, None] + transition[None, 1:]
        back[first[:n] + step] = paths.argmax(1)
        score[:n] = paths.max(1) + flat[first[:n] + step]
    tags = np.empty(len(flat), np.int64)
    tags[first + sizes[order] - 1] = score.argmax(1)
    for step, n in reversed(list(enumerate(live[1:], 1))):
        at = first[:n] + step
        tags[at - 1] = back[at, tags[at]]
    return np.split(tags, starts[1:])


def agrees(flat: np.ndarray, ends: np.ndarray, right: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Of which sentences ``viterbi`` finds the tags ``right``; they lie one after another and none is empty.

    The sums are those of ``viterbi``, but only the steps on the right path are looked at.
    """
    sizes = np.diff(ends, prepend=0)
    order, live = _by_length(sizes)
    first, by_tag = (ends - sizes)[order], np.ascontiguousarray(flat.T)
    score, follow = transition[0][:, None] + by_tag[:, first], transition[1:, :, None]
    before = np.empty_like(by_tag)
    for step, n in enumerate(live[1:], 1):
        at = first[:n] + step
        before[:, at] = score[:, :n]
        score[:, :n] = (score[:, None, :n] + follow).max(0) + by_tag[:, at]
    same = np.empty(len(ends), bool)
    same[order] = score.argmax(0) == right[ends[order] - 1]
    inner = np.ones(len(right), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    off = (before[:, at] + transition[1:][:, right[at]]).argmax(0) != right[at - 1]
    same[np.searchsorted(ends, at[off], "right")] = False
    return same


def marked(words: Sequence[str], automaton: Automaton) -> np.ndarray:
    """Tags of the listed names, from left to right the longest first; of several kinds the first."""
    tags, free = np.zeros(len(words), np.int64), 0
    for start, _, kind, end in sorted(automaton.hits(words), key=lambda h: (h[0], -h[3], h[2])):
        if start >= free:
            tags[start] = TAGS.index(f"B-{kind}")
            tags[start + 1:end + 1] = TAGS.index(f"I-{kind}")
            free = end + 1
    return tags


def named(words: Sequence[str], tags: np.ndarray) -> dict[str, list[str]]:
    """The names by kind, in reading order."""
    out: dict[str, list[list[str]]] = {kind: [] for kind in KINDS}
    for word, tag in zip(words, tags.tolist()):
        if tag:
            place, kind = TAGS[tag].split("-")
            if place == "B":
                out[kind].append([])
            out[kind][-1].append(word)
    return {kind: [" ".join(name) for name in names] for kind, names in out.items()}


def learn(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """One pass over ``(buckets, tags, ends)``: the weights at its end, their average, the sentences tagged wrongly and all.

    Weights change after a batch of ``BATCH`` sentences, by those tagged wrongly. Most batches
    have none, so as many as were right of late are decoded at once, up to the first wrong one.
    """
    weights, allowed, cut = np.concatenate([emission.ravel(), transition.ravel()]), follows(), emission.size
    emission, transition = weights[:cut].reshape(emission.shape), weights[cut:].reshape(transition.shape)
    summed, steps, held, wrong, seen, ahead = np.zeros(weights.size), 0, 0, 0, 0, 1
    for buckets, tags, ends in blocks:
        at, seen = 0, seen + len(ends)
        while at < len(ends):
            stop = min(len(ends), at + ahead * BATCH)
            start = int(ends[at - 1]) if at else 0
            own, right, scores = ends[at:stop] - start, tags[start:ends[stop - 1]], transition + allowed
            flat = emission[buckets[start:ends[stop - 1]]].sum(1)
            bad = np.flatnonzero(~agrees(flat, own, right, scores))
            if not len(bad):
                held, at, ahead = held - (at - stop) // BATCH, stop, min(2 * ahead, LOOK_AHEAD)
                continue
            batch = int(bad[0]) // BATCH
            bad = bad[bad // BATCH == batch]
            # the batches before it have these weights, and it has those it leaves
            summed += (held + batch) * weights
            steps, held = steps + held + batch, 1
            spans = [(int(own[i - 1]) if i else 0, int(own[i])) for i in bad]
            for (a, b), guess in zip(spans, viterbi([flat[a:b] for a, b in spans], scores)):
                off = np.flatnonzero(right[a:b] != guess)
                for path, sign in ((right[a:b], 1.0), (guess, -1.0)):
                    np.add.at(emission, (buckets[start + a + off], path[off, None]), sign)
                    np.add.at(transition, (np.concatenate([[0], path[:-1] + 1]), path), sign)
            wrong, at, ahead = wrong + len(bad), min(at + (batch + 1) * BATCH, stop), max(1, batch)
    summed, steps = summed + held * weights, steps + held
    return np.concatenate([weights, summed / max(steps, 1), [1.0, wrong, seen]])


def train_tagger(docs: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", settings: Learning = Learning()) -> Tagger:
    """A tagger from texts marked by ``gazetteer(phrase, kind)``.

    The gazetteer has to fit a broadcast; a longer one raises. Texts are read whole,
    sentences without a name too. Without texts every weight is zero and no name is found.
    Texts are dealt out and ordered by their key, so no task marks more than about ``TASK_TEXTS``.
    """
    names = listed_names(names_of(gazetteer))
    if names is None:
        raise ValueError("the gazetteer is too long to mark texts with")
    chosen, order = docs.select(F.col(text).alias("text"), key), (F.xxhash64(key), key, "text")
    if settings.sample_rows is not None:
        chosen = chosen.orderBy(*order).limit(settings.sample_rows)
    blocks = written(_marked_blocks(chosen.repartition(_tasks(chosen)).sortWithinPartitions(*order).select("text"), names, settings), "sentences")
    shapes = [(settings.buckets, len(TAGS)), (len(TAGS) + 1, len(TAGS))]
    cut = lambda flat: [p.reshape(s) for p, s in zip(np.split(flat, [shapes[0][0] * shapes[0][1]]), shapes)]
    size = sum(a * b for a, b in shapes)
    width = blocks.rdd.getNumPartitions()
    weights = average = np.zeros(size)
    for _ in range(settings.epochs):
        sent = docs.sparkSession.sparkContext.broadcast(weights)

        def one_pass(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = learn(_read_blocks(batches), *cut(sent.value))
            if sums[-1]:
                yield part_sum(sums)

        sums = tree_sum(blocks.mapInArrow(one_pass, SUMS), width)
        if not len(sums):
            break
        weights, average = sums[:size] / sums[-3], sums[size:2 * size] / sums[-3]
    return Tagger(*cut(average))


def _tasks(docs: DataFrame) -> int:
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_TEXTS))


def _marked_blocks(texts: DataFrame, names: Names, settings: Learning) -> DataFrame:
    """Sentences with the tags of listed names, in rows of ``BLOCK_WORDS`` words: the parts of ``Features.table`` as bytes."""
    sent = names.sent

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.buckets)
        for part in in_blocks(one.as_py() for batch in batches for one in batch.column(0)):
            sentences = [words for text in part for words in text]
            if sentences:
                tags = np.concatenate([marked(words, sent.value) for words in sentences]).astype(np.int8)
                yield pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, (x.tobytes() for x in (*features.table(sentences), tags))))], BLOCK)

    return texts.mapInArrow(mark, ", ".join(f"{n} binary" for n in BLOCK.names))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            rows, ids, ends, tags = (
                np.frombuffer(column[row].as_buffer(), kind) for column, kind in zip(batch.columns, (np.int32, np.int32, np.int32, np.int8)))
            yield spread(rows.reshape(-1, WIDTH), ids, ends), tags.astype(np.int64), ends


def tagged_names(df: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """``df`` with ``locations`` and ``organizations``, each in reading order; a null text has none.

    A text takes far longer to tag than to move, so rows are dealt out: no task tags more
    than about ``TASK_TEXTS``, however large the splits of the input.
    """
    sent = df.sparkSession.sparkContext.broadcast((tagger.emission, tagger.transition + follows()))
    shape = pa.struct([(k, pa.list_(pa.string())) for k in KINDS])

    @F.arrow_udf("struct<" + ", ".join(f"{k}: array<string>" for k in KINDS) + ">")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emission, transition = sent.value
        features = Features(len(emission))
        for batch in batches:
            rows = []
            for part in in_blocks(one.as_py() for one in batch):
                sentences = [words for text in part for words in text]
                tags: Iterator[np.ndarray] = iter(())
                if sentences:
                    table = features.table(sentences)
                    tags = iter(viterbi(np.split(emission[spread(*table)].sum(1), table[-1][:-1]), transition))
                for text in part:
                    row: dict[str, list[str]] = {k: [] for k in KINDS}
                    for words, own in zip(text, tags):
                        if own.any():
                            for kind, names in named(words, own).items():
                                row[kind] += names
                    rows.append(row)
            yield pa.array(rows, shape)

    return df.repartition(_tasks(df)).withColumn("_tagged", find(F.col(text))).select(
        *df.columns, F.col("_tagged.GPE").alias("locations"), F.col("_tagged.ORG").alias("organizations"))
