"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

No piece of a usable vocabulary goes on after a letter with a blank, and none holds a line break, so the lattice of a
text falls apart exactly at the blanks before words and at line breaks. The lattices of the distinct words of a batch are
built and summed forward together, one place at a time, and all words of all texts are sampled backward together. The random
numbers depend on the row's key, the seed, and the place only, so a row is segmented alike wherever it runs. Decoding joins the
pieces' bytes and returns the text without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import SpanHashes, flat, hash_spans, mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weight of a piece: (1 + rank) ** -SHARPNESS; greater values stay closer to the best segmentation.
SHARPNESS = 0.3
SEED = 1
#: Weight of a character that has no piece and is spelled by its bytes.
SPELLED = 1e-5
PIECE = 2 << 20
DECODED_ROWS = 1_000
WORDS = 16_384
_HINTS = 22
_GOLDEN = 0x9E3779B97F4A7C15
_BLANK, _BREAK = 0x20, 0x0A


class Vocabulary:
    """Pieces of a model file with blanks in place of their mark, found by hash; the numbers of the byte pieces."""

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int64)
        usable: list[tuple[int, bytes]] = []
        for k in range(loaded.vocab_size()):
            piece = loaded.id_to_piece(k)
            if loaded.is_byte(k):
                self.byte_id[int(piece[3:-1], 16)] = k
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif loaded.is_control(k) or loaded.is_unknown(k) or loaded.is_unused(k):
                self.bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.bytes.append(text.encode())
                # Others are decoded, but never sampled: they would span two words.
                if " " not in text.lstrip(" ") and "\n" not in text:
                    usable.append((k, text.encode()))
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks byte pieces, so decoding would lose text")
        keys = self._keys([raw for _, raw in usable])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([k for k, _ in usable])[order]
        score = np.array([loaded.get_score(int(k)) for k in self.ids])
        self.log_weight = -sharpness * np.log1p(np.abs(score))
        texts = [raw.decode() for _, raw in usable]
        heads = sorted({t[:k] for t in texts for k in range(1, len(t) + 1)})
        # By hash: 1 where a piece may begin like this, 2 where one may be this.
        self._hints = np.zeros(1 << _HINTS, np.uint8)
        self._hints[self._slots(self._keys([h.encode() for h in heads]))] |= 1
        self._hints[self._slots(keys)] |= 2

    @staticmethod
    def _keys(texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        return SpanHashes(np.frombuffer(b"".join(texts), np.uint8)).raw(ends - sizes, ends)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_GOLDEN)) >> np.uint64(64 - _HINTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys are pieces, those pieces' places, and which keys longer pieces may begin with."""
        hints = self._hints[self._slots(keys)]
        maybe = np.flatnonzero(hints & 2)
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        return maybe[hit], at[hit], np.flatnonzero(hints & 1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, text: a word with the blanks before it, a line break, or blanks before one."""
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[offsets] = True
    starts = starts[:-1]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    broken = data == _BREAK
    blank = data == _BLANK
    starts |= broken
    starts[1:] |= broken[:-1] | (blank[1:] & ~blank[:-1])
    first = np.flatnonzero(starts)
    return first, np.append(first[1:], len(data)), np.searchsorted(offsets, first, "right") - 1


class Lattices:
    """The lattices of distinct words. A node stands after a character; edges into a node lie together, in the order
    of nodes, with cumulative probability added to the node's number."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
        """``words``: the bytes of all words; ``starts``: where each begins. No word is empty."""
        self.words, self.vocabulary = words, vocabulary
        self.chars = np.flatnonzero((words & 0xC0) != 0x80)
        ends = np.append(self.chars[1:], len(words))
        n = len(self.chars)
        head = np.searchsorted(self.chars, starts)
        sizes = np.diff(np.append(head, n))
        self.end = head + sizes - 1
        depth = np.arange(n) - np.repeat(head, sizes)
        left = np.repeat(sizes, sizes) - depth  # characters from here to the word's end
        hashes = SpanHashes(words)
        into, piece, weight, length = [], [], [], []
        alive, size = np.arange(n), 0
        while len(alive):
            size += 1
            alive = alive[left[alive] >= size]
            hit, at, longer = vocabulary.find(hashes.raw(self.chars[alive], ends[alive + size - 1]))
            into.append(alive[hit] + size - 1)
            piece.append(vocabulary.ids[at])
            weight.append(vocabulary.log_weight[at])
            length.append(np.full(len(hit), size))
            if size == 1:
                spelled = np.ones(n, dtype=bool)
                spelled[hit] = False
                spelled = np.flatnonzero(spelled)
                into.append(spelled)
                piece.append(-1 - spelled)  # the character, to be spelled
                weight.append(np.full(len(spelled), np.log(SPELLED)))
                length.append(np.ones(len(spelled), np.int64))
            alive = alive[longer]
        node, log, size = np.concatenate(into), np.concatenate(weight), np.concatenate(length)
        order = np.argsort(node, kind="stable")
        node, log, size = node[order], log[order], size[order]
        self.piece = np.concatenate(piece)[order]
        self.before = np.where(size > depth[node], -1, node - size)
        first = np.searchsorted(node, np.arange(n + 1))  # every node has an edge
        # Forward sums, all nodes of one depth at a time; the last entry stands before every word.
        forward = np.zeros(n + 1)
        by_depth = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2 if n else 1))
        counts = np.diff(first)
        for low, high in zip(level, level[1:], strict=False):
            nodes = by_depth[low:high]
            own = counts[nodes]
            heads = np.cumsum(own) - own
            edges = np.repeat(first[nodes] - heads, own) + np.arange(own.sum())
            value = forward[self.before[edges]] + log[edges]
            top = np.maximum.reduceat(value, heads)
            forward[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, own)), heads))
        share = np.cumsum(np.exp(forward[self.before] + log - forward[node]))
        base = np.concatenate([[0], share[first[1:-1] - 1]]) if n else share
        self.cumulative = node + np.minimum(share - base[node], 1.0)
        self.cumulative[first[1:] - 1] = np.arange(n) + 1.0

    def sample(self, word: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of every asked word in order, and their number per word; backward from the words' ends."""
        active, node = np.arange(len(word)), self.end[word]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(word), np.int64)
        while len(active):
            draw = (mix(state[active] + np.uint64(len(steps) * _GOLDEN % 2**64)) >> np.uint64(11)) * 2.0**-53
            # Rounding must not reach the next node.
            aim = np.minimum(node + draw, (node + 1) * (1 - 2.0**-52))
            edge = np.searchsorted(self.cumulative, aim, "right")
            steps.append((active, self.piece[edge]))
            counts[active] += 1
            node = self.before[edge]
            going = node >= 0
            active, node = active[going], node[going]
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.int64)
        for t, (who, what) in enumerate(steps):
            out[last[who] - t] = what
        return out, counts

    def spell(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces."""
        odd = ids < 0
        if not odd.any():
            return ids, owner
        at = self.chars[-1 - ids[odd]]
        ends = np.append(self.chars, len(self.words))
        times = np.ones(len(ids), np.int64)
        times[odd] = ends[-ids[odd]] - at
        out = np.repeat(ids, times)
        places = np.repeat(at, times[odd]) + np.arange(times[odd].sum())
        places -= np.repeat(np.cumsum(times[odd]) - times[odd], times[odd])
        out[np.repeat(odd, times)] = self.vocabulary.byte_id[self.words[places]]
        return out, np.repeat(owner, times)


def _row_state(keys: pa.Array, seed: int) -> np.ndarray:
    if pa.types.is_integer(keys.type):
        plain = keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    else:
        plain = np.array([xxhash.xxh64_intdigest(str(k.as_py()).encode()) for k in keys], dtype=np.uint64)
    return mix(plain + np.uint64(seed * _GOLDEN % 2**64))


def encode_batch(texts: pa.Array, state: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All pieces, and how many each text has."""
    data, offsets = flat(texts)
    first, last, doc = units(data, offsets)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    _, sample, word = np.unique(hash_spans(data, first, last), return_index=True, return_inverse=True)
    held = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(held) - held, held)
    state = mix(state[doc] + place.astype(np.uint64))
    # Equal words together: a few thousand lattices at a time, whose edges stay in the cache.
    order = np.argsort(word, kind="stable")
    counts = np.empty(len(doc), np.int64)
    found = []
    for at in range(0, len(sample), WORDS):
        some = sample[at : at + WORDS]
        sizes = (last - first)[some]
        starts = np.cumsum(sizes) - sizes
        words = data[np.repeat(first[some] - starts, sizes) + np.arange(sizes.sum())]
        lattices = Lattices(words, starts, vocabulary)
        low, high = np.searchsorted(word, [at, at + WORDS], sorter=order)
        asked = order[low:high]
        ids, own = lattices.sample(word[asked] - at, state[asked])
        ids, owner = lattices.spell(ids, np.repeat(np.arange(len(asked)), own))
        counts[asked] = np.bincount(owner, minlength=len(asked))
        found.append(ids.astype(np.int32))
    begin = np.cumsum(counts) - counts
    sorted_counts = counts[order]
    ahead = np.cumsum(sorted_counts) - sorted_counts
    out = np.empty(int(counts.sum()), np.int32)
    out[np.repeat(begin[order] - ahead, sorted_counts) + np.arange(len(out))] = np.concatenate(found)
    return out, np.bincount(doc, counts, len(texts)).astype(np.int64)


def lossless(texts: pa.Array, ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Whether the pieces of each text are its very bytes."""
    data, offsets = flat(texts)
    sizes = np.array([len(b) for b in vocabulary.bytes])
    blob = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
    own = sizes[ids]
    ends = np.cumsum(own)
    spelled = blob[np.repeat((np.cumsum(sizes) - sizes)[ids] - ends + own, own) + np.arange(own.sum())]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    good = np.diff(bounds) == np.diff(offsets)
    for k in np.flatnonzero(good):
        good[k] = np.array_equal(spelled[bounds[k] : bounds[k + 1]], data[offsets[k] : offsets[k + 1]])
    return good


def encode(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """The rows with ``pieces``, an array of piece numbers sampled for the row's key, and ``lossless``, whether their
    bytes are those of the text (compared in the same pass); other columns are kept.

    Null and empty texts have no piece and are lossless. Rows of equal key and text are segmented alike; a null key counts as
    0. Existing columns of the two names are replaced. Empty tables give none. The vocabulary (a fixed file) goes to every task.
    """
    vocabulary = Vocabulary(model, sharpness)  # goes out with the function, which is read where no package is installed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, PIECE):
            state = _row_state(part.column(key_col), seed)
            ids, counts = encode_batch(part.column(text_col), state, vocabulary)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            same = lossless(part.column(text_col), ids, counts, vocabulary)
            yield _with(_with(part, "pieces", found), "lossless", pa.array(same))

    rows = docs.drop("pieces", "lossless")
    shape = _shape(rows, "pieces", T.ArrayType(T.IntegerType())).add("lossless", T.BooleanType())
    return rows.mapInArrow(run, shape)


def decode(frame: DataFrame, pieces_col: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """The rows with the text of their pieces; null pieces give null. A column of that name is replaced."""
    shared = frame.sparkSession.sparkContext.broadcast(Vocabulary(model, SHARPNESS).bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                texts = [
                    None if not row.is_valid else b"".join(map(look, row.values.to_numpy().tolist())).decode()
                    for row in part.column(pieces_col)
                ]
                yield _with(part, out, pa.array(texts, pa.string()))

    return frame.drop(out).mapInArrow(run, _shape(frame, out, T.StringType()))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _shape(frame: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*frame.drop(name).schema.fields, T.StructField(name, kind)])
