"""Language-model scores by logistic context mixing.

A text is a row of tokens: its words with A-Z as a-z, then one end. Two scores are given, both log10 probabilities of
all its tokens. The base score is a unigram model with one added to every count. The other comes from a bitwise model:
the tokens are spelt as one row of bytes (a word ends with STOP), the bytes as bits, and for every bit several
predictors, each with the counts of zeros and ones seen after one hashed context (the last one to six bytes of the
text, whichever words they belong to, or the whole word so far), give their logit. A mixer adds the logits with weights
that are gated by the bit's place and by how much the two longest contexts have seen. Last, an adaptive probability map
refines the mix by the order-one context. A token's probability is the product over its bits, given what stands before
it, so the probabilities of all words and the end sum to one at most, and a text's score depends on the order of its words.

An event is a byte with all that the predictors see of what is before it: up to six bytes (WINDOW: all in one number)
and the word so far (a hash). What is learnt: the count of every distinct training event (a table that grows with the
corpus), and from all of these the predictors' counts, in hashed tables of a fixed size. The weights are learnt online,
mini-batch after mini-batch: events are dealt to slices by the hash of their context, as many as there are SLICE_WORDS
distinct words, the first slice is learnt alone, then every slice goes on from where the first ended, all at once, and
the ends are averaged, each gate by the mini-batches that met it. In learning, one occurrence of the event at hand is
taken out of the counts, so that it meets events as unseen as those of new texts. Slices, their order inside and all
sums (of whole numbers) depend on the events alone, so scores are the same for any number of partitions and any size of
Arrow batch.

Frequent words are those with at least 1 in LEAST_SHARE of all training tokens, so there can't be more of them than
LEAST_SHARE; only they are broadcast. The others, none of which can be hot, are joined by a shuffle.

Words and beginnings of words are told apart by 64-bit hashes. Defined cases: null texts count as empty, and are one end; rows with a null
doc_id are training rows; repeated rows are scored each; without training rows all counts are 0 and base scores too;
an empty table gives no rows; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .pu import fold
from .textbatch import FOLD, SPACE, Texts, mix, pieces, powers

LEAST_SHARE = 1_000_000
_HASH_BASE = np.uint64(0xD6E8FEB86659FD93)
END = b"\n"  # spelt by this byte alone; no word holds it
STOP = 32  # ends a word's spelling
ORDERS = (1, 2, 3, 4, 6)  # bytes of context, over word boundaries; a last context is the whole word so far
REACH = max(ORDERS)
BITS = (16, 19, 20, 20, 20, 22)
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in BITS]))).astype(np.int64)
SLOTS = int(STARTS[-1])
CHUNK = 1 << 15
N_CHUNKS = -(-SLOTS // CHUNK)
INPUTS = len(BITS) + 1
LEVELS = 6
GATES = 8 * LEVELS * LEVELS
_CELLS = 65536 * 24 + 1
STEPS = 24  # columns of the probability map, over logits from -STEPS / 2 to STEPS / 2
SLICE_WORDS, MINI_BATCH = 50_000, 8192  # words; events
_FIXED = 1 << 20  # weights are averaged as whole numbers of this fraction
STRETCH = 1 << 15  # bytes spelt at once, or one word: what is made of them stays in a core's cache
KEPT, WAITING = 3 << 19, 1 << 19  # distinct events that a task sums before it passes them on; rows that wait to be summed
TALLY_BITS, PLACE_BITS = 21, 22  # places for counts, and for scores, of events met before
BUCKET, BUCKETS = 1 << 21, 4096  # bytes of text whose events are summed together; more of them where there would be more buckets
BLOCK = 1 << 13  # events scored at once
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z as a-z, all white space as STOP.
_FOLDED = np.where(SPACE, STOP, FOLD).astype(np.uint8)


@dataclass
class Spelling:
    """Distinct events: contexts for each, the byte, and, where words or texts are spelt, which event each byte is and whose."""

    contexts: np.ndarray  # inputs - 1 columns of uint64, column after column
    byte: np.ndarray
    event: np.ndarray  # one for each byte of each word, word after word
    word: np.ndarray

    @cached_property
    def near(self) -> list[list[np.ndarray]]:
        """For each half of the byte and each context but the first: what its nodes' slots are near to.

        Four bits in a row have their slots in sixteen that are side by side, and so in one line of a processor's cache;
        which of the sixteen is which node's depends on the hash, so that all slots are used alike.
        """
        halves = [self.contexts.T[1:] * _GOLD]
        halves.append((self.contexts.T[1:] + ((self.byte >> 4).astype(np.uint64) + np.uint64(16)) * _HASH_BASE) * _GOLD)
        return [[(h >> np.uint64(64 - b)).view(np.int64) for h, b in zip(half, BITS[1:], strict=True)] for half in halves]

    @cached_property
    def row(self) -> np.ndarray:
        """Order-one context, above 8 bits for the node."""
        return (self.contexts[:, 0] & np.uint64(255)).view(np.int64) << 8

    def nodes(self, bit: int) -> np.ndarray:
        return (self.byte.astype(np.int64) | 256) >> (8 - bit)

    def slots(self, half: int) -> list[list[np.ndarray]]:
        """For each context and each bit of half a byte: the slot of each event in the context's table."""
        inside = ((self.byte >> 4 if half == 0 else self.byte & 15) | 16).astype(np.int64)
        steps = [inside >> (4 - b) for b in range(4)]  # 1 to 15
        return [[self.row | self.nodes(4 * half + b) for b in range(4)], *([near ^ step for step in steps] for near in self.near[half])]


def windows_of(text: np.ndarray, low: int, high: int, tops: np.ndarray) -> np.ndarray:
    """WINDOW of the bytes low to high: the byte in the lowest 8 bits, above it 9 for each of the REACH bytes before (0: none, else 1 more).

    tops: where texts begin, ascending.
    """
    first, n = max(0, low - REACH), high - low
    one = np.zeros(REACH + n, np.uint64)
    one[REACH - (low - first) :] = text[first:high]
    one[REACH - (low - first) :] += np.uint64(1)
    two = (one[:-1] << np.uint64(9)) | one[1:]
    four = (two[:-2] << np.uint64(18)) | two[2:]
    six = (two[:-4] << np.uint64(36)) | four[2:]
    out = six[:n] << np.uint64(8)
    out |= text[low:high]
    near = tops[np.searchsorted(tops, low - REACH, "right") : np.searchsorted(tops, high)] - low
    for k in range(REACH):
        at = near + k
        out[at[(at >= 0) & (at < n)]] &= _INSIDE[k]
    return out


_INSIDE = np.array([(1 << (8 + 9 * k)) - 1 for k in range(REACH + 1)], np.uint64)


def beginnings(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the word so far for each byte; text: words of these lengths, one after the other."""
    if not len(text):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(text)) - np.repeat(begin, lengths)
    value = text.astype(np.uint64)
    value += np.uint64(1)
    value *= powers(int(lengths.max()) + 1).take(place)
    sums = np.cumsum(value)  # modulo 2^64
    sums -= value  # of all bytes before
    sums -= np.repeat(sums[begin], lengths)
    sums += place.view(np.uint64) * _HASH_BASE
    return mix(sums)


def event_keys(window: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    return so_far + window * _GOLD


def spelling(window: np.ndarray, so_far: np.ndarray, event: np.ndarray | None = None, word: np.ndarray | None = None) -> Spelling:
    """The contexts of events."""
    before = [(window >> np.uint64(9 * k - 1)) & np.uint64(511) for k in range(1, REACH + 1)]
    columns = []
    for n in ORDERS:
        h = np.full(len(window), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(271) + before[k]
        columns.append(h if n == 1 else mix(h))
    columns.append(mix(so_far + np.uint64(99)))
    none = np.zeros(0, np.int64)
    return Spelling(np.array(columns).T, (window & np.uint64(255)).astype(np.uint8), none if event is None else event, none if word is None else word)


def spell(words: list[bytes]) -> Spelling:
    """Words that have nothing before them."""
    text = np.frombuffer(b"".join(w if w == END else w + b" " for w in words), np.uint8)
    lengths = np.array([len(w) if w == END else len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    window = windows_of(text, 0, len(text), np.cumsum(lengths) - lengths)
    so_far = beginnings(text, lengths)
    _, first, event = np.unique(event_keys(window, so_far), return_index=True, return_inverse=True)
    return spelling(window[first], so_far[first], event, word)


@dataclass
class Row:
    """All tokens of texts, spelt one after the other; text i begins at tops[i]."""

    text: np.ndarray
    tops: np.ndarray
    to: np.ndarray  # where each token ends

    @staticmethod
    def of(texts: Texts) -> Row:
        data, at, n = texts.data.tobytes(), texts.offsets.tolist(), len(texts)
        folded = _FOLDED[np.frombuffer(b"".join(x for a, b in zip(at[:-1], at[1:], strict=True) for x in (data[a:b], b" \n")), np.uint8)]
        ends = texts.offsets[1:] + 2 * np.arange(1, n + 1) - 1
        folded[ends] = END[0]
        kept = folded != STOP
        word = kept.copy()
        word[ends] = False
        kept[1:] |= word[:-1]  # one STOP after each word
        text = folded[kept]
        to = np.flatnonzero((text == STOP) | (text == END[0])) + 1
        return Row(text, np.append(0, to[text[to - 1] == END[0]]), to)

    def stretches(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Whole tokens: where they begin and end, and the bytes' windows and words so far."""
        a, low = 0, 0
        while a < len(self.to):
            b = max(a + 1, int(np.searchsorted(self.to, low + STRETCH, "right")))
            high = int(self.to[b - 1])
            yield low, high, windows_of(self.text, low, high, self.tops), beginnings(self.text[low:high], np.diff(self.to[a:b], prepend=low))
            a, low = b, high

    def sums(self, low: int, high: int, values: np.ndarray) -> tuple[slice, np.ndarray]:
        """The texts of a stretch, and sums over them of a value per byte."""
        a, b = int(np.searchsorted(self.tops, low, "right")) - 1, int(np.searchsorted(self.tops, high))
        return slice(a, b), np.add.reduceat(values, np.maximum(self.tops[a:b] - low, 0))


def spelt(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole tokens over all texts: the text of each byte, which event it is, and the events' keys, windows and words so far."""
    row = Row.of(texts)
    for low, high, window, so_far in row.stretches():
        event, keys = pd.factorize(event_keys(window, so_far))
        first = np.empty(len(keys), np.int64)
        first[event[::-1]] = np.arange(len(event))[::-1]
        yield np.searchsorted(row.tops, np.arange(low, high), "right") - 1, event, keys, window[first], so_far[first]


def slots_of(s: Spelling, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Table slot of each event and context for the bit of that place (0: highest), and the bit."""
    return np.array([x[bit % 4] + start for x, start in zip(s.slots(bit // 4), STARTS, strict=False)]).T, ((s.byte >> (7 - bit)) & 1).astype(np.int64)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 15, then eighths of their logarithm to base 2."""
    large = 16 + np.round(8 * np.log2(np.maximum(counts, 16) / 16))
    return np.where(counts < 15.5, np.round(counts), np.minimum(large, 255)).astype(np.uint8)


_DECODED = np.concatenate([np.arange(16.0), 16 * 2 ** (np.arange(240) / 8)])


def _pairs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit, and how much has been seen (0 to LEVELS - 1), for each pair of coded counts of zeros and ones."""
    total = zeros[:, None] + ones[None, :]
    level = sum((total > x).astype(np.int64) for x in (0, 3, 30, 300, 3000))
    return np.log((ones[None, :] + 0.3) / (zeros[:, None] + 0.3)).astype(np.float32).ravel(), level.ravel()


_LESS = np.maximum(_DECODED - 1, 0)
#: By pair; then by bit and pair, with one occurrence of the bit taken out.
LOGIT, SEEN = _pairs(_DECODED, _DECODED)
_OUT = [_pairs(_LESS, _DECODED), _pairs(_DECODED, _LESS)]
LOGIT_OUT, SEEN_OUT = np.concatenate([x[0] for x in _OUT]), np.concatenate([x[1] for x in _OUT])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


_SEEN = SEEN.astype(np.uint8)


def _gates(bit: int, seen_4: np.ndarray, seen_word: np.ndarray) -> np.ndarray:
    return (bit * LEVELS + seen_4) * LEVELS + seen_word


def _map_cells(s: Spelling, bit: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower cell of the probability map (order-one context and node, by logit), and how far x is above it."""
    at = np.clip(x + STEPS / 2, 0, STEPS - 1.001)
    low = at.astype(np.int64)
    return (s.row | s.nodes(bit)) * STEPS + low, at - low


@dataclass
class Tables:
    """What scoring needs: each slot's pair of coded counts, the weights and the map."""

    pairs: np.ndarray
    weights: np.ndarray
    refined: np.ndarray  # probability of a one by map cell
    met: Met | None = None  # of the Python worker that scores, for all its tasks

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word (or END)."""
        if not words:
            return np.zeros(0)
        s = spell(words)
        return np.bincount(s.word, self.event_scores(s)[s.event], len(words))

    def event_scores(self, s: Spelling) -> np.ndarray:
        """log10 probability of each byte after what is before it."""
        total = np.ones(len(s.byte))
        tables = [self.pairs[low : low + (1 << b)] for low, b in zip(STARTS, BITS, strict=False)]
        weights = np.ascontiguousarray(self.weights.reshape(8, LEVELS * LEVELS, INPUTS).transpose(0, 2, 1))
        for bit in range(8):
            if bit % 4 == 0:  # context by context, as the slots of four bits are near each other
                pairs = [[table.take(x, mode="clip").astype(np.int64) for x in four] for table, four in zip(tables, s.slots(bit // 4), strict=True)]
            pair = [four[bit % 4] for four in pairs]
            gate = (_SEEN.take(pair[3]) * LEVELS + _SEEN.take(pair[5])).astype(np.int64)
            z = weights[bit, -1].take(gate)
            for x, w in zip(pair, weights[bit], strict=False):
                z += LOGIT.take(x) * w.take(gate)
            cell, up = _map_cells(s, bit, z)
            low = self.refined.take(cell)
            p = 0.5 * _squash(z) + 0.5 * (low + up * (self.refined.take(cell + 1) - low))
            p = np.clip(p, 1e-6, 1 - 1e-6)
            total *= np.where((s.byte >> (7 - bit)) & 1, p, 1 - p)
        return np.log10(total)

    def byte_scores(self, window: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        """event_scores; those of events met before are kept."""
        met = self.met = self.met or Met()
        keys = event_keys(window, so_far)
        place = (keys >> np.uint64(64 - PLACE_BITS)).view(np.int64)
        found = met.scores.take(place)
        new = np.flatnonzero(met.keys.take(place) != keys)
        for low in range(0, len(new), BLOCK):
            at = new[low : low + BLOCK]
            found[at] = self.event_scores(spelling(window[at], so_far[at]))
        met.keys[place[new]] = keys[new]
        met.scores[place[new]] = found[new]
        return found

    def text_scores(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text, its end included, and how many bytes it is spelt with."""
        row, scores = Row.of(texts), np.zeros(len(texts))
        for low, high, window, so_far in row.stretches():
            of, sums = row.sums(low, high, self.byte_scores(window, so_far))
            scores[of] += sums
        return scores, np.diff(row.tops)


class Met:
    """Scores of events met before, by the key's first bits; the last one stays."""

    def __init__(self) -> None:
        self.keys, self.scores = np.zeros(1 << PLACE_BITS, np.uint64), np.zeros(1 << PLACE_BITS)
        self.keys[0] = 1 << 63  # no key of place 0


def _distinct(texts: Texts) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """doc and kind of every word; the distinct words, their hashes and counts."""
    words = texts.words(fold=True)
    kind, hashes = pd.factorize(words.hashes)
    counts, first = np.bincount(kind, minlength=len(hashes)), np.empty(len(hashes), np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    data = texts.data.tobytes()
    spelt = [data[a:b].lower() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    return words.doc, kind, spelt, hashes.view(np.int64), counts


def word_counts(documents: DataFrame, training: Column) -> DataFrame:
    """hash, word, n of every distinct token of the training rows; the end has the hash -1 and the word END."""
    store.ship(documents.sparkSession)
    df = documents.where(F.coalesce(training, F.lit(True))).select(F.col("text").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", 4 << 20):
                texts = Texts.of(part.column(0))
                _, _, words, hashes, counts = _distinct(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, -1)), pa.array([*words, END], pa.binary()), pa.array(np.append(counts, len(texts)))], names=["hash", "word", "n"])

    counted = df.mapInArrow(count, "hash long, word binary, n long")
    return counted.groupBy("hash", "word").agg(F.sum("n").alias("n"))


class Tally:
    """Counts of events by the key's first bits. An event whose place another takes is passed on with its count."""

    def __init__(self) -> None:
        self.keys, self.window, self.so_far = (np.zeros(1 << TALLY_BITS, np.uint64) for _ in range(3))
        self.n = np.zeros(1 << TALLY_BITS, np.int64)
        self.keys[0] = 1 << 63  # no key of place 0
        self.passed: list[tuple[np.ndarray, ...]] = [_summed([(self.window[:0], self.so_far[:0], self.n[:0])])]

    def add(self, window: np.ndarray, so_far: np.ndarray) -> None:
        keys = event_keys(window, so_far)
        place = (keys >> np.uint64(64 - TALLY_BITS)).view(np.int64)
        met = self.keys.take(place) == keys
        np.add.at(self.n, place[met], 1)
        new = np.flatnonzero(~met)
        at, keys, window, so_far = place[new], keys[new], window[new], so_far[new]
        self.leave(np.unique(at))
        self.keys[at], self.window[at], self.so_far[at] = keys, window, so_far
        held = self.keys.take(at) == keys  # of several for one place, the last
        np.add.at(self.n, at[held], 1)
        if not held.all():
            self.passed.append((window[~held], so_far[~held], np.ones(int((~held).sum()), np.int64)))

    def leave(self, at: np.ndarray) -> None:
        at = at[self.n.take(at) > 0]
        self.passed.append((self.window.take(at), self.so_far.take(at), self.n.take(at)))
        self.n[at] = 0

    def sum(self, most: int) -> bool:
        """Sum what has been passed on, if it is more than so many rows since the last time; whether there is more than KEPT then."""
        if sum(len(x[0]) for x in self.passed[1:]) > most:
            self.passed = [_summed(self.passed)]
        return len(self.passed[0][0]) > KEPT

    def rest(self, parts: int = 8) -> Iterator[tuple[np.ndarray, ...]]:
        """All counts, one row for each event, a range of keys at a time."""
        self.passed = [_summed(self.passed)]
        window, so_far, n, keys = self.passed[0]
        at = np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
        for k, (low, high) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)):
            self.passed = [(window[low:high], so_far[low:high], n[low:high])]
            self.leave(np.arange(k * len(self.n) // parts, (k + 1) * len(self.n) // parts))
            yield _summed(self.passed)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Windows, words so far, counts and keys of events, with one row for each event, in the order of the keys."""
    window, so_far, n = (np.concatenate([x[i] for x in parts]) for i in range(3))
    keys = event_keys(window, so_far)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    n = np.add.reduceat(n[order], first) if len(keys) else n
    order = order[first]
    return window[order], so_far[order], n, keys[first]


def event_counts(documents: DataFrame, training: Column) -> DataFrame:
    """window, so_far, n of every distinct event of the training rows.

    Tasks pass their counts on in buckets of events, by hash, and each bucket is summed by itself.
    """
    store.ship(documents.sparkSession)
    df = documents.where(F.coalesce(training, F.lit(True))).select(F.col("text").alias("_text"))
    buckets = min(BUCKETS, 1 + (df.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0) // BUCKET)

    def packed(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        *columns, keys = rows
        packer, bucket = zstandard.ZstdCompressor(1), ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(keys)])
        blobs = [packer.compress(b"".join(x[a:b].tobytes() for x in columns)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in pieces(batch, "_text"):
                for _, _, window, so_far in Row.of(Texts.of(part.column(0))).stretches():
                    tally.add(window, so_far)
                    if tally.sum(WAITING):
                        yield packed(tally.passed[0])
                        tally.passed = [tuple(x[:0] for x in tally.passed[0])]
        for rows in tally.rest():
            yield packed(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now, most, unpacker = None, KEPT, zstandard.ZstdDecompressor()

        def whole() -> pa.RecordBatch:
            window, so_far, n, _ = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (window.view(np.int64), so_far.view(np.int64), n)], names=["window", "so_far", "n"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != now:
                    yield whole()
                    held = []
                now = bucket
                window, so_far, n = np.frombuffer(unpacker.decompress(blob.as_buffer()), np.uint64).reshape(3, -1)
                held.append((window, so_far, n.view(np.int64)))
                if len(held) > 1 and sum(len(x[0]) for x in held) > most:
                    held = [_summed(held)[:3]]
                    most = max(KEPT, 2 * len(held[0][0]))
        if held:
            yield whole()

    parted = df.mapInArrow(count, "bucket int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    return parted.mapInArrow(add, "window long, so_far long, n long")


def tokens_of(events: DataFrame) -> DataFrame:
    """hash, n of every distinct token: each is one event, with its last byte (STOP, or the end, whose hash is -1), whatever is before it."""
    last = F.col("window").bitwiseAND(F.lit(255))
    word = F.when(last == END[0], F.lit(-1)).otherwise(F.col("so_far"))
    return events.where(last.isin(STOP, END[0])).groupBy(word.cast("long").alias("hash")).agg(F.sum("n").alias("n"))


def word_events(vocabulary: DataFrame) -> DataFrame:
    """window, so_far, n of every distinct event of words (hash, word, n) that have nothing before them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            text = np.frombuffer(b"".join(w if w == END else w + b" " for w in words), np.uint8)
            lengths = np.array([len(w) if w == END else len(w) + 1 for w in words], np.int64)
            window = windows_of(text, 0, len(text), np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window.view(np.int64), beginnings(text, lengths).view(np.int64), np.repeat(n, lengths))], names=["window", "so_far", "n"])

    return vocabulary.select("word", "n").mapInArrow(count, "window long, so_far long, n long").groupBy("window", "so_far").agg(F.sum("n").alias("n"))


def predictor_counts(events: DataFrame, distinct: int) -> DataFrame:
    """chunk, counts (zeros, then ones, int64, compressed): the predictors' counts over all events, summed chunk by chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = N_CHUNKS * CHUNK
        sums = np.zeros(2 * width, np.int64)
        for batch in batches:
            window, so_far, weight = (batch.column(i).to_numpy() for i in range(3))
            for low in range(0, len(weight), BLOCK):
                at = slice(low, low + BLOCK)
                s = spelling(window.view(np.uint64)[at], so_far.view(np.uint64)[at])
                ones = [((s.byte >> (7 - bit)) & 1).astype(np.int64) * width for bit in range(8)]
                for half in range(2):
                    for start, four in zip(STARTS, s.slots(half), strict=False):
                        for b in range(4):
                            np.add.at(sums, four[b] + (ones[4 * half + b] + start), weight[at])
        packer, both = zstandard.ZstdCompressor(1), sums.reshape(2, N_CHUNKS, CHUNK)
        for c in np.flatnonzero(both.any((0, 2))):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([packer.compress(both[:, c].tobytes())], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        packer, unpacker = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for batch in batches:
            for c, x in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                x = np.frombuffer(unpacker.decompress(x), np.int64)
                held[c] = held[c] + x if c in held else x
        for c, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([packer.compress(x.tobytes())], pa.binary())], names=["chunk", "counts"])

    kinds = "chunk long, counts binary"
    few = events.select("window", "so_far", "n").coalesce(max(1, -(-distinct // (4 * SLICE_WORDS))))  # a task's tables are worth the events of some words
    return few.mapInArrow(count, kinds).repartition("chunk").mapInArrow(add, kinds)


def first_weights() -> np.ndarray:
    """Before learning, the longest context that has seen something leads."""
    w = np.zeros((8, LEVELS, LEVELS, INPUTS))
    w[:, 0, :, [1, 2]] = 0.4
    w[:, 1:, :, 2] = 0.3
    w[:, 1:, :, 3] = 0.6
    w[:, :, 2:, :] *= 0.2
    w[:, :, 2:, 5] = 0.8
    return w.reshape(GATES, INPUTS)


@dataclass
class Mixer:
    """Weights of each gate, how much each has bent (for Newton steps), how many mini-batches met it, counts of the map's cells (zeros, ones)."""

    weights: np.ndarray
    past: np.ndarray
    met: np.ndarray
    cells: np.ndarray

    @staticmethod
    def new() -> Mixer:
        return Mixer(first_weights(), np.tile(20 * np.eye(INPUTS), (GATES, 1, 1)), np.zeros(GATES, np.int64), np.zeros(2 * _CELLS, np.int64))

    def learn(self, s: Spelling, weight: np.ndarray, pairs: np.ndarray) -> None:
        """Online Newton steps over the bits of the events, which come so many times each."""
        order = np.argsort(mix(s.contexts[:, -1]), kind="stable")  # what follows one beginning is met together
        mean = weight.mean() if len(weight) else 1.0
        for low in range(0, len(order), MINI_BATCH):
            at = order[low : low + MINI_BATCH]
            part = Spelling(s.contexts.T[:, at].T, s.byte[at], at, at)
            for bit in range(8):
                if bit % 4 == 0:
                    four = [[pairs[start : start + (1 << b)].take(x, mode="clip") for x in xs] for start, b, xs in zip(STARTS, BITS, part.slots(bit // 4), strict=False)]
                self._step(part, bit, weight[at], weight[at] / mean, [x[bit % 4] for x in four])

    def _step(self, part: Spelling, bit: int, n: np.ndarray, w: np.ndarray, pairs: list[np.ndarray]) -> None:
        y = ((part.byte >> (7 - bit)) & 1).astype(np.int64)
        pair = [x + (y << 16) for x in pairs]
        x = np.ones((len(n), INPUTS), np.float32)
        for i, a in enumerate(pair):
            x[:, i] = LOGIT_OUT.take(a)
        gate = _gates(bit, SEEN_OUT.take(pair[3]), SEEN_OUT.take(pair[5]))
        mixed = np.einsum("ij,ij->i", x, self.weights[gate])
        cell, up = _map_cells(part, bit, mixed)
        np.add.at(self.cells, cell + (up > 0.5) + y * _CELLS, n.astype(np.int64))
        p = _squash(mixed)
        error, bend = (y - p) * w, w * np.maximum(p * (1 - p), 1e-4)
        by_gate = np.argsort(gate, kind="stable")
        met, begin = np.unique(gate[by_gate], return_index=True)
        x = x[by_gate]
        slope = np.add.reduceat(x * error[by_gate, None], begin)
        xb = x * bend[by_gate, None].astype(np.float32)
        for g, low, high in zip(met, begin, [*begin[1:], len(x)], strict=True):
            self.past[g] += xb[low:high].T @ x[low:high]
        change = np.linalg.solve(self.past[met], slope[:, :, None])[:, :, 0]
        self.weights[met] = np.clip(self.weights[met] + np.clip(change, -0.2, 0.2), -1, 2)
        self.met[met] += 1


def _by_slice(events: DataFrame, learn: Callable[[Spelling, np.ndarray], pa.RecordBatch], kinds: str) -> DataFrame:
    """What learn makes of the events and counts of each slice, in the order of their keys; events: slice, window, so_far, n."""
    df = events.select("slice", "window", "so_far", "n").repartition("slice").sortWithinPartitions("slice", "so_far", "window")

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        window, so_far, n = (pa.Table.from_batches(held).column(i).to_numpy() for i in (1, 2, 3))
        return learn(spelling(window.view(np.uint64), so_far.view(np.uint64)), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = batch.column(0).to_numpy()
            ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
            for low, high in zip([0, *ends[:-1]], ends, strict=True):
                if held and of[low] != now:
                    yield whole(held)
                    held = []
                now = of[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield whole(held)

    return df.mapInArrow(run, kinds)


def train(vocabulary: DataFrame, distinct: int) -> Tables:
    """Tables from a vocabulary (hash, word, n) of so many words, as if each stood alone."""
    return train_events(word_events(vocabulary), distinct)


def train_events(events: DataFrame, distinct: int) -> Tables:
    """Tables from the events (window, so_far, n) of texts with so many distinct words."""
    spark = events.sparkSession
    counts, unpacker = np.zeros((2, N_CHUNKS * CHUNK), np.int64), zstandard.ZstdDecompressor()
    for r in predictor_counts(events, distinct).toLocalIterator():  # N_CHUNKS rows
        counts[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(unpacker.decompress(r.counts), np.int64).reshape(2, CHUNK)
    pairs = (coded(counts[0]).astype(np.uint16) << 8) | coded(counts[1])
    del counts
    events = events.withColumn("slice", F.pmod(F.xxhash64(F.shiftright("window", 8), "so_far"), F.lit(max(1, -(-distinct // SLICE_WORDS)))))
    held = spark.sparkContext.broadcast(pairs)

    def first(s: Spelling, n: np.ndarray) -> pa.RecordBatch:
        m = Mixer.new()
        m.learn(s, n, held.value)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.weights, m.past)], names=["weights", "past"])

    start = _by_slice(events.where("slice = 0"), first, "weights binary, past binary").collect()  # one row at most
    begun = Mixer.new()
    for r in start:
        begun.weights, begun.past = np.frombuffer(r.weights).reshape(begun.weights.shape), np.frombuffer(r.past).reshape(begun.past.shape)
    going = spark.sparkContext.broadcast((begun.weights, begun.past))

    def further(s: Spelling, n: np.ndarray) -> pa.RecordBatch:
        m = Mixer.new()
        m.weights, m.past = (x.copy() for x in going.value)
        m.learn(s, n, held.value)
        cells, gates = m.cells.reshape(2, _CELLS), np.flatnonzero(m.met)
        hit = np.flatnonzero(cells.any(0))
        fixed = np.round(m.weights[gates] * _FIXED).astype(np.int64) * m.met[gates, None]
        at = (gates[:, None] * INPUTS + np.arange(INPUTS)).ravel()
        columns = [np.repeat([0, 1], [len(at), len(hit)]), np.append(at, hit), np.append(fixed.ravel(), cells[0, hit]), np.append(np.repeat(m.met[gates], INPUTS), cells[1, hit])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "at", "a", "b"])

    learnt = _by_slice(events, further, "kind long, at long, a long, b long").groupBy("kind", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()  # a row for each weight and cell
    kind, at, a, b = (learnt.column(i).to_numpy() for i in range(4))
    weights, refined = begun.weights.ravel().copy(), np.tile(_squash(np.arange(STEPS) - STEPS / 2), 65536)
    weights[at[kind == 0]] = a[kind == 0] / b[kind == 0] / _FIXED
    z, o, at = a[kind == 1], b[kind == 1], at[kind == 1]
    z, o, at = z[at < len(refined)], o[at < len(refined)], at[at < len(refined)]
    refined[at] = (o + 10 * refined[at]) / (z + o + 10)
    held.unpersist()
    going.unpersist()
    return Tables(pairs, weights.reshape(GATES, INPUTS).astype(np.float32), np.append(refined, 0.5).astype(np.float32))


def score(documents: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of documents.

    training: whether a row's tokens are learnt from (null: yes).
    """
    spark = documents.sparkSession
    store.ship(spark)
    events = store.cut(event_counts(documents, training), "events")
    vocabulary = store.cut(tokens_of(events), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tables = train_events(events, distinct) if total else None
    often = vocabulary.where(F.col("n") >= F.lit(max(1, -(-total // LEAST_SHARE)))).select("hash", "n").orderBy("hash").toArrow()  # at most LEAST_SHARE rows
    end = vocabulary.where(F.col("hash") == -1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = spark.sparkContext.broadcast((*(often.column(i).to_numpy() for i in range(2)), tables))
    floor = total + distinct + 1
    df = documents.select("doc_id", F.coalesce(~training, F.lit(False)).alias("held_out"), F.col("text").alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, frequent_n, model = held.value
        base, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in pieces(batch, "_text", 2 << 20):
                texts = Texts.of(part.column(2))
                rows = len(texts)
                spelt_row, words = Row.of(texts), []
                scores, n_bytes = np.zeros(rows), np.diff(spelt_row.tops)
                for low, high, window, so_far in spelt_row.stretches():
                    words.append(so_far[spelt_row.text[low:high] == STOP])
                    if model:
                        of, sums = spelt_row.sums(low, high, model.byte_scores(window, so_far))
                        scores[of] += sums
                code, hashes = pd.factorize(np.concatenate(words).view(np.int64))
                doc, hashes = np.repeat(np.arange(rows), np.diff(np.searchsorted(spelt_row.to, spelt_row.tops, "right")) - 1), np.append(hashes, -1)
                at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
                known = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
                counts = np.where(known, frequent_n[at] if len(frequent) else 0, 0)
                known[-1], counts[-1] = end > 0, end
                plain = np.log10((counts + 1) / floor) if total else np.zeros(len(hashes))
                doc, code = np.concatenate([doc, np.arange(rows)]), np.concatenate([code, np.full(rows, len(hashes) - 1)])
                sure = known[code]
                rare = ~sure & (code < len(hashes) - 1)
                pairs, tf = np.unique(doc[rare] * len(hashes) + code[rare], return_counts=True)
                ends = np.searchsorted(pairs // len(hashes), np.arange(rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (hashes[pairs % len(hashes)], tf)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(base + done + np.arange(rows)), pa.array(np.bincount(doc, minlength=rows)), pa.array(np.bincount(doc, sure, rows).astype(np.int64)),
                    pa.array(np.bincount(doc, np.where(sure, plain[code], 0.0), rows)), pa.array(scores), pa.array(n_bytes), *lists,
                ], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare", "times"])
                done += rows

    out = store.cut(df.mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<long>, times array<long>"), "lm-rows")
    rare = out.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    counts = vocabulary.groupBy("hash").agg(F.sum("n").alias("n"))
    found = rare.join(counts, "hash", "left")
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(floor)))).alias("more_base"),
    )
    out = out.drop("rare", "times").join(more, "row", "left")
    base = F.col("base_score") + F.coalesce("more_base", F.lit(0.0)) if total else F.lit(0.0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def language_model(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """score with the rows of one fold of crc32(doc_id as text) held out."""
    return score(documents, fold("doc_id", folds) != held)
