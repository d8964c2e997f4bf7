"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of test items, one scan per text."""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..operators.spark_support import stored
from .textkit import LETTERS_ONLY

#: Letters of test items in one automaton; larger sets of items are scanned in several blocks.
BLOCK_CHARS = 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS_ONLY).split() if text else []


def windows_of(items: list[tuple[str, str | None]], width: int) -> dict[bytes, set[str]]:
    """Windows of `width` consecutive words with the items they occur in; a shorter item is one window."""
    found = defaultdict(set)
    for item, text in items:
        words = normalised_words(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found[b" ".join(words[i:i + size])].add(item)
    return found


def _automaton(items: list[tuple[str, str | None]], width: int) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for window, where in windows_of(items, width).items():
        # one letter per byte; the blanks keep matches at word limits
        machine.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, sorted(where)))
    if len(machine):
        machine.make_automaton()
    return machine


#: The automaton of the block that a worker is scanning, by the digest of its items.
_machines: dict[str, ahocorasick.Automaton] = {}


def _word_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code-point ranges of the original text."""
    if not len(hit):
        return []
    limits = [m.span() for m in _WORD.finditer(text)]
    cuts = np.flatnonzero(np.diff(hit) > 1)
    return [{"start": limits[a][0], "end": limits[b][1]}
            for a, b in zip(hit[np.append(0, cuts + 1)].tolist(), hit[np.append(cuts, len(hit) - 1)].tolist(), strict=True)]


def _scan(items, digest: str, width: int, last: bool):
    """Tasks: adds the hits of one block of items (a broadcast list) to those of the blocks before."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(items, digest, width)
        for batch in batches:
            counts, hits, where, spans = [], [], [], []
            for value, before, met in zip(batch["text"], batch["hit_words"], batch["items"], strict=True):
                words = normalised_words(value)
                counts.append(len(words))
                found, names = [before], set(met)
                if words and len(machine):
                    plain = b" " + b" ".join(words) + b" "
                    matches = list(machine.iter(plain.decode("latin-1")))
                    if matches:
                        blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                        ends = np.searchsorted(blanks, [end for end, _ in matches])
                        for end, (_, (size, items_here)) in zip(ends.tolist(), matches, strict=True):
                            found.append(np.arange(end - size, end))
                            names.update(items_here)
                hit = np.unique(np.concatenate(found)).astype(np.int32) if len(found) > 1 else np.asarray(before, np.int32)
                hits.append(hit)
                where.append(sorted(names))
                if last:
                    spans.append(_word_spans(value, hit))
            out = batch.assign(n_words=counts, hit_words=hits, items=where)
            yield out.drop(columns=["text"]).assign(spans=spans) if last else out
    return run


def _blocks(items: DataFrame, item_col: str, item_text_col: str, width: int) -> Iterator[tuple[Broadcast, str]]:
    """Items in blocks of bounded size, broadcast one after the other, each with the digest of its content."""
    spark = items.sparkSession
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")) \
        .where(F.col("text").isNotNull())
    letters = words.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // BLOCK_CHARS))
    dealt = words.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for b in range(blocks):
        own = [tuple(r) for r in dealt.where(F.col("block") == b).select("item", "text").collect()]
        digest = hashlib.md5(repr((width, sorted(own))).encode("utf-8", "surrogatepass")).hexdigest()
        yield spark.sparkContext.broadcast(own), digest


def _machine(items: Broadcast, digest: str, width: int) -> ahocorasick.Automaton:
    """The worker's automaton of a block; workers keep the last one between tasks."""
    if digest not in _machines:
        _machines.clear()
        _machines[digest] = _automaton(items.value, width)
    return _machines[digest]


def without_leaks(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text_col: str, width: int = 10) -> DataFrame:
    """Rows of docs without any occurrence of a window of the items; null and wordless texts stay. Nothing is shuffled."""
    for sent, digest in _blocks(items, item_col, item_text_col, width):
        docs = docs.where(~F.pandas_udf(_any_hit(sent, digest, width), "boolean")(F.col(text_col)))
    return docs


def _any_hit(items: Broadcast, digest: str, width: int):
    def run(texts: pd.Series) -> pd.Series:
        machine = _machine(items, digest, width)
        out = []
        for text in texts:
            words = normalised_words(text)
            plain = (b" " + b" ".join(words) + b" ").decode("latin-1") if words and len(machine) else ""
            out.append(bool(plain) and next(machine.iter(plain), None) is not None)
        return pd.Series(out, dtype=bool)
    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
               width: int = 10) -> DataFrame:
    """One row per document: id, n_words, hit_words (indices), items (ids as sorted strings), spans (code points).

    A window is `width` consecutive words of an item, or the whole of a shorter item; every word inside an occurrence is
    hit. Null and wordless texts of documents and items have no words and no hits. Repeated documents give repeated
    rows; repeated items count once; an item without an id has the id ''. Without items nothing is hit.
    Items are a stated query set: they are dealt into blocks of bounded size, one automaton each, and every
    block is scanned against all documents. The part of a block is sent to tasks, never the documents.
    """
    blocks = list(_blocks(items, item_col, item_text_col, width))
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_words"),
                        F.array().cast("array<string>").alias("items"))
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, {{}}n_words long, hit_words array<int>, items array<string>"
    for number, (sent, digest) in enumerate(blocks, 1):
        last = number == len(blocks)
        schema = shape.format("") + ", spans array<struct<start:int,end:int>>" if last else shape.format("text string, ")
        state = state.mapInPandas(_scan(sent, digest, width, last), schema)
        if not last:
            state = stored(state, "leaks")
    return state

