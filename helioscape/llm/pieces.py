"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary comes from a SentencePiece model file; segmentation, byte fallback and decoding are done here, within
tasks. At every position the automaton's output links give all pieces that end there, longest first; each relaxes the
best score of the position by that of its start.

Scores of a unigram model are log-probabilities, and the best sum wins. Scores of a merge (BPE) model are ranks of
merges, whose best sum is not the model's segmentation. There a step is admissible only if its piece and the piece
before it are what merging their joint text gives; every position then has one admissible last piece, and the path
equals that of the merges.

Pieces never reach over the blank before a word, so the path of a text is the paths of its words one after the other,
and those of frequent words are remembered.
"""
from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textkit import give_back

BLANK = "▁"
#: Words in one of the two generations that a worker remembers.
CACHE = 100_000
_UNKNOWN_PENALTY = 10.0
_RUNS = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order with score and kind: n(ormal), b(yte), u(nknown) or c(ontrol)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    dummy_prefix: bool = True
    merging: bool = False


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a SentencePiece model file that a library can open on the driver; tasks get it by broadcast."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    ids = range(model.get_piece_size())
    kind = lambda i: "b" if model.is_byte(i) else "u" if model.is_unknown(i) else "c" if model.is_control(i) or model.is_unused(i) else "n"
    return Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids),
                      "".join(map(kind, ids)), proto.normalizer_spec.add_dummy_prefix,
                      proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE)


class _Words(dict):
    """word -> packed ids. Two generations: when the young one is full it becomes the old one, so frequent words stay."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self[word] = self.old.get(word) or self.encode(word)
        return found


class Encoder:
    """Encodes and decodes single texts; holds the automaton and the remembered words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.machine = ahocorasick.Automaton()
        normal = [i for i, k in enumerate(vocabulary.kinds) if k == "n" and vocabulary.pieces[i]]
        for i in normal:
            self.machine.add_word(vocabulary.pieces[i], i)
        if normal:
            self.machine.make_automaton()
        self.lengths = [len(p) if k == "n" else 1 for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.letters = frozenset(p for p in (vocabulary.pieces[i] for i in normal) if len(p) == 1)
        self.bytes = {int(vocabulary.pieces[i][3:5], 16): i for i, k in enumerate(vocabulary.kinds) if k == "b"}
        self.unknown = vocabulary.kinds.find("u")
        self.unknown_score = min((vocabulary.scores[i] for i in normal), default=0.0) - _UNKNOWN_PENALTY
        self.table = [bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else " ⁇ ".encode() if k == "u"
                      else p.replace(BLANK, " ").encode() for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        # words may be cut apart where no piece holds a blank behind a letter, lines where none holds a line end
        pieces = [vocabulary.pieces[i] for i in normal]
        self.by_word = BLANK in self.letters and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.by_line = not any("\n" in p for p in pieces)
        self.ids = {vocabulary.pieces[i]: i for i in normal}
        self.admitted: dict[int, bool] = {}
        self.line_end = self._packed("\n")
        self.after_blank = _Words(lambda w: self._packed(BLANK + w))
        self.at_start = _Words(self._packed)

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equal ones the longer last piece wins."""
        if self.vocabulary.merging:
            return self._spelled(text, self._merged(text) if BLANK in text[1:] else self._admissible(text))
        size, lengths, scores = len(text), self.lengths, self.vocabulary.scores
        best, back = [-np.inf] * (size + 1), [self.unknown] * (size + 1)
        best[0] = 0.0
        strange = [] if self.letters.issuperset(text) else [i for i, c in enumerate(text) if c not in self.letters]
        upcoming = iter([*strange, size])
        gap = next(upcoming)
        for last, piece in self.machine.iter(text) if lengths else ():
            while gap < last:  # a letter without a piece is one step, before anything that ends beyond it
                self._skip(best, back, gap)
                gap = next(upcoming)
            value = best[last + 1 - lengths[piece]] + scores[piece]
            if value > best[last + 1]:
                best[last + 1], back[last + 1] = value, piece
        while gap < size:
            self._skip(best, back, gap)
            gap = next(upcoming)
        return self._spelled(text, self._walk(back, size))

    def _walk(self, back: list[int], at: int) -> list[int]:
        lengths, path = self.lengths, []
        while at:
            piece = back[at]
            path.append(piece)
            at -= lengths[piece]
        path.reverse()
        return path

    def _spelled(self, text: str, path: list[int]) -> list[int]:
        """The path with letters that have no piece spelled in bytes, where the vocabulary has those."""
        if not self.bytes or self.unknown not in path:
            return path
        out, at = [], 0
        for piece in path:
            if piece == self.unknown:
                out += [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(piece)
            at += self.lengths[piece]
        return out

    def _admissible(self, text: str) -> list[int]:
        """The path on which every two neighbours are what merging gives: one last piece per position."""
        unknown, lengths, admitted, size = self.unknown, self.lengths, self.admitted, len(self.lengths)
        back = [-1] * (len(text) + 1)
        back[0] = unknown
        if not self.letters.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.letters:
                    back[i + 1] = unknown
        for last, piece in self.machine.iter(text) if lengths else ():
            if back[last + 1] < 0:
                before = back[last + 1 - lengths[piece]]
                if before == unknown:
                    back[last + 1] = piece
                else:
                    pair = before * size + piece
                    fits = admitted.get(pair)
                    if self._learn(pair) if fits is None else fits:
                        back[last + 1] = piece
        return self._walk(back, len(text))

    def _learn(self, pair: int) -> bool:
        if len(self.admitted) >= 4 * CACHE:
            self.admitted.clear()
        both = list(divmod(pair, len(self.lengths)))
        fits = self.admitted[pair] = self._merged("".join(self.vocabulary.pieces[i] for i in both)) == both
        return fits

    def _merged(self, text: str) -> list[int]:
        """The merges themselves: of the neighbours whose joint text is a piece the best scored, leftmost join, again and again."""
        parts, ids, scores = list(text), self.ids, self.vocabulary.scores
        after = [*range(1, len(parts)), -1]  # neighbours that are left; joined parts are None
        ahead = [*range(-1, len(parts) - 1)]
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (piece := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (-scores[piece], i, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while waiting:
            _, i, joined = heapq.heappop(waiting)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or len(parts[i]) + len(parts[j]) != len(joined) or parts[i] + parts[j] != joined:
                continue  # one of the two has been joined since
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[i] >= 0:
                ahead[after[i]] = i
            offer(i)
            offer(ahead[i])
        return [ids.get(p, self.unknown) for p in parts if p is not None]

    def _skip(self, best: list[float], back: list[int], at: int) -> None:
        if best[at] + self.unknown_score > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + self.unknown_score, self.unknown

    def _packed(self, text: str) -> bytes:
        return array("i", self.best_path(text)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return np.empty(0, np.int32)
        if not (self.by_word and self.by_line):
            marked = text.replace(" ", BLANK)
            return np.array(self.best_path(BLANK + marked if self.vocabulary.dummy_prefix else marked), np.int32)
        out = []
        for number, line in enumerate(text.replace(BLANK, " ").split("\n")):
            if number:
                out.append(self.line_end)
            words = line.split(" ")
            if not number and self.vocabulary.dummy_prefix:
                words.insert(0, "")
            first = words.pop(0)
            if first:
                out.append(self.at_start[first])
            if "" in words:  # a run of blanks belongs to the word behind it
                words = [m.replace(" ", BLANK) for m in _RUNS.findall(" " + " ".join(words))]
                words = [w[1:] for w in words]
            out += map(self.after_blank.__getitem__, words)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes are joined as UTF-8, blanks restored, the blank before the first word removed."""
        if not len(ids):
            return ""
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def _encoder(sent: Broadcast) -> Encoder:
    """The worker's encoder of a vocabulary."""
    vocabulary = sent.value
    name = hash(vocabulary)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


def _broadcast(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    if len(vocabulary.pieces) > 1_000_000:
        raise ValueError("a vocabulary of over a million pieces is not sent to tasks")
    return spark.sparkContext.broadcast(vocabulary)


def encode_texts(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary, check: bool = False) -> DataFrame:
    """(id, ids array<int>) and with `check` also round_trip: whether decoding gives the text back.

    Whole texts of any length; null and empty texts have no ids. Repeated rows are repeated; other columns are not
    read. A text that itself holds the blank mark reads as if it held blanks.
    """
    sent = _broadcast(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = [encoder.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                if check:
                    columns.append(pa.array([encoder.decode(x) == (t or "").replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "round_trip"][:len(columns)])
        # remembered words would stay beside the stages that follow
        del encoder
        _encoders.clear()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, ids array<int>" + ", round_trip boolean" * check)


def decode_ids(encoded: DataFrame, id_col: str, ids_col: str, vocabulary: Vocabulary) -> DataFrame:
    """(id, text) of arrays of ids; null and empty arrays are ''. Ids beyond the vocabulary are an error."""
    sent = _broadcast(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
