"""Packing of tokenised texts into sequences of a fixed capacity, balanced by attention cost.

A text costs a linear part (projections, feed-forward) and a quadratic part (attention within the text). Texts are taken by
falling length, each to the cheapest sequence that has room for it; what fits nowhere is cut to the cheapest sequence's room
and its rest goes on as a shorter text. Sequences of a block are sized to its tokens: full ones, and powers of two for the
remainder, so that all are filled to the last token and none needs padding.

Each task packs blocks of its own texts as it reads them: no shuffle, and memory for one block and one text.
"""
from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import partial
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
#: Tokens after which a task closes a block: 512 full sequences and at most eleven shorter ones.
BLOCK_TOKENS = 512 * CAPACITY
#: Cost of a text of n tokens is LINEAR * n + n * n: the quadratic part outweighs the linear one from this length on.
LINEAR = 4096
#: Words whose ids a worker remembers, and the longest such word.
KEPT_WORDS, KEPT_LENGTH = 300_000, 40


def cost(tokens: int) -> int:
    return LINEAR * tokens + tokens * tokens


def sizes_for(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence sizes that hold the tokens exactly: full ones, then the powers of two in the remainder."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (text, start, length, sequence, offset) of a block of texts with the given numbers of tokens."""
    room = np.array(sizes_for(sum(lengths), capacity), np.int64)
    used = np.zeros(len(room), np.int64)
    spent = np.zeros(len(room), np.int64)
    waiting = [(-n, text, 0) for text, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    out = []
    while waiting:
        left, text, start = heapq.heappop(waiting)
        left = -left
        fits = np.flatnonzero(room >= left)
        if not len(fits):
            fits = np.flatnonzero(room)
        # the cheapest; of equal ones that with the most room, so that long texts are cut least often
        chosen = int(fits[np.argmin(spent[fits] * (capacity + 1) - room[fits])])
        size = min(left, int(room[chosen]))
        out.append((text, start, size, chosen, int(used[chosen])))
        used[chosen] += size
        room[chosen] -= size
        spent[chosen] += cost(size)
        if size < left:
            heapq.heappush(waiting, (size - left, text, start + size))
    return out


#: Marks at the end of a word that are split off it: a run of them is never tokenised together with a letter before it.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_{|}~'


class WordIds(dict):
    """Word between blanks -> its ids as little-endian 32-bit integers; the words of a text are tokenised independently.

    Holds two generations of words, so that frequent ones stay however many there are.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(model)
        self.merges = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        names = ((c, self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100))
        self.letters = {c: found[0][0] for c, found in names if found}
        self.letters |= {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in (0xAA, 0xB5, 0xBA)}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode_word(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode_word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and latin(core):
            plain = core.lower()
            if plain != word:
                return self[plain] + self[word[len(core):]]
            # one run of small letters: nothing to normalise or to split, only its bytes are renamed
            ids = [t.id for t in self.merges.tokenize(word if word.isascii() else word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes() if byteorder == "little" else np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" not in text and latin(text):  # small letters first, but never make the name of a special token
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def latin(text: str) -> bool:
    """Whether a text keeps to Latin-1, where letters and their small forms are the same in every library."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_words: tuple[str, WordIds] | None = None


def word_ids(model: str) -> WordIds:
    """The worker's table for a model; one model is held at a time."""
    global _words
    if _words is None or _words[0] != model:
        _words = (model, WordIds(model))
    return _words[1]


_SCHEMA = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()),
                     ("text_tokens", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])


def _pack_task(batches: Iterator[pa.RecordBatch], model: str, end_id: int, capacity: int, block_tokens: int, id_type) -> Iterator[pa.RecordBatch]:
    words, end = word_ids(model), np.array([end_id], "<u4").tobytes()
    schema = _SCHEMA.set(0, pa.field("id", id_type))
    number = TaskContext.get().partitionId() << 32
    ids, packed, tokens = [], [], 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal number
        pieces = pack([len(p) // 4 for p in packed], capacity)
        for first in range(0, len(pieces), 1024):
            text, start, size, sequence, offset = zip(*pieces[first:first + 1024])
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[t] for t in text], id_type), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.array([packed[t][4 * a:4 * (a + n)] for t, a, n in zip(text, start, size)], pa.binary()),
                pa.array([len(packed[t]) // 4 for t in text], pa.int64()),
                pa.array([number + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())], schema=schema)
        number += 1 + max((p[3] for p in pieces), default=-1)

    for batch in batches:
        for i in range(batch.num_rows):
            ids.append(batch.column(0)[i].as_py())
            packed.append(words.encode(batch.column(1)[i].as_py() or "") + end)
            tokens += len(packed[-1]) // 4
            if tokens >= block_tokens:
                yield from block()
                ids, packed, tokens = [], [], 0
    if packed:
        yield from block()


def pack_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (id, start, length, tokens, text_tokens, sequence, offset): the pieces of every text, packed.

    tokens holds the piece's ids as little-endian 32-bit integers; text_tokens counts the text's ids with the end mark. A
    null or empty text is its end mark alone. Rows that share an id, or have none, are texts of their own. `tokenizer` is a
    model file that the driver can read and whose words end at blanks. capacity is a power of two. Other columns are
    ignored; an empty table gives no rows. Sequence numbers hold the task in their upper half, so they are unique.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    task = partial(_pack_task, model=model, end_id=end_id, capacity=capacity, block_tokens=block_tokens, id_type=to_arrow_type(kind))
    return rows.mapInArrow(task, f"id {kind.simpleString()}, start long, length long, tokens binary, text_tokens long, "
                                 "sequence long, offset long")
