"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised to lower-case words. The automaton's states are the distinct runs of up to ten words of the items, so that the windows of an item share their states, and the failure
link of a run is the run without its first word, which is a state too. States are numbers in the order of (state before, word): one sorted array of such keys is
all that a step needs. It is built once, written to the shared folder, and mapped into the memory of all workers. It scans each text once, many
stretches of a batch of texts at a time. A match ends at a word, whose place in the original text is found again for documents with a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.shared import new_path, small_batches
from tidewindow.llm.textvec import ALNUM, word_hashes

#: Bytes of benchmark text that the driver reads to build the automaton, and bytes of the built one; more of either is an error. A word of the benchmark takes some
#: hundred bytes of the latter, which is mapped, not copied, where the shared folder is a file system of the machine.
MAX_BENCHMARK_BYTES, MAX_AUTOMATON_BYTES = 64_000_000, 2_000_000_000
#: Words of a stretch, at least and at most; each begins a window early, after which its state is that of a scan from the start.
STRETCH = (64, 1024)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
_OPENED: dict[str, Automaton] = {}


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(ALNUM).split()


@dataclass
class Automaton:
    """Arrays of an automaton. State 0 has read nothing, state i + 1 is reached by ``keys[i]``: the state before times 2^32, and the word's number.

    ``fail``: the state of the longest shorter run; ``out``: the state of the longest run, itself or shorter, that is a window, 0 if none is; both by state. ``depth``: the words of a state by state.
    ``words``: sorted hashes of the benchmark's words. The items of a window are ``items[first[k] : first[k + 1]]``, with k its place in ``windows``.
    """

    words: np.ndarray
    keys: np.ndarray
    fail: np.ndarray
    out: np.ndarray
    depth: np.ndarray
    windows: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self))

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after one word each; -1 is a word that the benchmark doesn't have."""
        states = np.where(words < 0, 0, states)
        todo = np.flatnonzero(words >= 0)
        while len(todo):
            keys = states[todo].astype(np.uint64) << np.uint64(32) | words[todo].astype(np.uint64)
            at = np.searchsorted(self.keys, keys)
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            before = states[todo]
            states[todo] = np.where(there, at + 1, self.fail[before])
            todo = todo[~there & (before > 0)]
        return states

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those that the benchmark doesn't have."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == hashes, at, -1) if len(self.words) else np.full(len(hashes), -1)

    def scan(self, words: np.ndarray, window: int) -> np.ndarray:
        """The state after each of the words."""
        n = len(words)
        size = int(np.clip(n // 4096, *STRETCH))
        stretches = -(-n // size)
        padded = np.full(window - 1 + stretches * size, -1, dtype=np.int64)
        padded[window - 1 : window - 1 + n] = words
        grid = np.lib.stride_tricks.sliding_window_view(padded, window - 1 + size)[::size]
        states, told = np.zeros(stretches, dtype=np.int64), np.empty((stretches, size), dtype=np.int64)
        for t in range(window - 1 + size):
            states = self.step(states, grid[:, t])
            if t >= window - 1:
                told[:, t - window + 1] = states
        return told.ravel()[:n]

    def hits(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and windows that end there, all of them, of the states after each word."""
        places, found = [], []
        at, now = np.arange(len(states)), self.out[states]
        while len(at := at[now > 0]):
            now = now[now > 0]
            places.append(at)
            found.append(now)
            now = self.out[self.fail[now]]
        return (np.concatenate(places), np.concatenate(found)) if places else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The numbers of the items that have any of the windows."""
        k = np.searchsorted(self.windows, np.unique(windows))
        return np.unique(np.concatenate([self.items[self.first[i] : self.first[i + 1]] for i in k])) if len(k) else np.empty(0, dtype=np.int64)


def build_automaton(texts: Sequence[np.ndarray], owners: Sequence[int], window: int) -> Automaton:
    """The automaton of texts, given as hashes of their words, and the number of the item that each is of."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.concatenate([*texts, np.empty(0, dtype=np.uint64)])
    words, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words up to the end of the item
    starts = np.arange(len(flat))
    state = np.zeros(len(flat) + 1, dtype=np.int64)  # of the run from each word on, as long as in the last round
    keys, fail, depth, known = [np.empty(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int32)], [np.zeros(1, dtype=np.uint8)], 1
    ends = np.zeros(len(flat), dtype=np.int64)  # of the windows that start at each word
    short = np.repeat(sizes, sizes)
    opens = left == short
    for d in range(1, window + 1):
        starts = starts[left[starts] >= d]
        key = state[starts].astype(np.uint64) << np.uint64(32) | codes[starts + d - 1]
        own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys.append(own)
        fail.append((state[starts[first] + 1] if d > 1 else np.zeros(len(own))).astype(np.int32))
        depth.append(np.full(len(own), d, dtype=np.uint8))
        new = np.zeros(len(flat) + 1, dtype=np.int64)
        new[starts] = known + inverse
        state, known = new, known + len(own)
        ends[starts] = np.where((d == window) | opens[starts] & (short[starts] == d), state[starts], ends[starts])
    keys, fail, depth = np.concatenate(keys), np.concatenate(fail), np.concatenate(depth)
    owner = np.repeat(np.array(owners, dtype=np.int64), sizes)
    pairs = np.unique(np.stack([ends[ends > 0], owner[ends > 0]]), axis=1)
    windows, first = np.unique(pairs[0], return_index=True)
    out = np.zeros(len(fail), dtype=np.int32)
    out[windows] = windows
    bounds = np.searchsorted(depth, np.arange(window + 2))
    for d in range(1, window + 1):  # failure links lead to shorter runs
        level = np.arange(bounds[d], bounds[d + 1])
        out[level] = np.where(out[level] > 0, out[level], out[fail[level]])
    return Automaton(words, keys, fail, out, depth, windows.astype(np.int32), np.append(first, pairs.shape[1]), pairs[1].astype(np.int32))


def _store(automaton: Automaton, folder: str) -> None:
    """The arrays as files of the shared folder."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    for f in fields(automaton):
        with store.open_output_stream(f"{base}/{f.name}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(getattr(automaton, f.name)), allow_pickle=False)


def _open(folder: str) -> Automaton:
    """The automaton of a folder, mapped where the folder is of a local file system and read otherwise; a worker holds one."""
    if folder not in _OPENED:
        _OPENED.clear()
        store, base = fs.FileSystem.from_uri(folder)
        arrays = {}
        for f in fields(Automaton):
            if isinstance(store, fs.LocalFileSystem):
                arrays[f.name] = np.load(f"{base}/{f.name}.npy", mmap_mode="r")
            else:
                with store.open_input_file(f"{base}/{f.name}.npy") as file:
                    arrays[f.name] = np.lib.format.read_array(file, allow_pickle=False)
        _OPENED[folder] = Automaton(**arrays)
    return _OPENED[folder]


def spans_of(text: str, hits: list[int]) -> list[dict[str, int]]:
    """Code-point spans, end exclusive, of the runs of the words at the sorted places ``hits``."""
    spans: list[dict[str, int]] = []
    if hits:
        places, last = [m.span() for m in _WORD.finditer(text)], -2
        for i in hits:
            if i == last + 1:
                spans[-1]["end"] = places[i][1]
            else:
                spans.append({"start": places[i][0], "end": places[i][1]})
            last = i
    return spans


def _scanner(folder: str, ids, window: int):
    """A pandas UDF of a text that finds hits in one scan over the words of a batch."""

    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _open(folder)
        for texts in batches:
            hashed = [word_hashes(t, ALNUM) for t in texts]
            sizes = np.array([len(h) for h in hashed], dtype=np.int64)
            begins = np.cumsum(sizes + 1) - sizes - 1  # a word that no item has stands between texts
            words = np.full(int(sizes.sum()) + len(sizes), -1, dtype=np.int64)
            for b, h in zip(begins, hashed, strict=True):
                words[b : b + len(h)] = automaton.numbers(h)
            ends, found = automaton.hits(automaton.scan(words, window)) if len(automaton.keys) else (np.empty(0, dtype=np.int64),) * 2
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(marks, ends - automaton.depth[found] + 1, 1)
            np.add.at(marks, ends + 1, -1)
            hit = np.cumsum(marks[:-1]) > 0
            order = np.argsort(ends, kind="stable")
            ends, found = ends[order], found[order]
            rows = []
            for text, n, b in zip(texts, sizes, begins, strict=True):
                lo, hi = np.searchsorted(ends, (b, b + n))
                own = np.flatnonzero(hit[b : b + n]).tolist()
                rows.append((int(n), len(own), sorted(ids.value[i] for i in automaton.items_of(found[lo:hi])), spans_of(text, own)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    return scan


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_benchmark_bytes: int = MAX_BENCHMARK_BYTES,
    max_automaton_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """``documents`` under a struct ``doc``, with ``n_words, n_hit, item_ids, spans, contaminated``.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A document's word
    within any occurrence of a window is hit; ``item_ids`` has the sorted ids of the items that occur, and
    ``spans`` the code points of the runs of hit words. Null, empty and wordless texts have
    no words and no hits; such items have no windows. Items that repeat an id count once, a null id counts as the
    empty string, and an empty benchmark finds nothing. More benchmark text than ``max_benchmark_bytes``, or a larger automaton than ``max_automaton_bytes``, is an error. Words are
    told apart by 64-bit hashes. Every row of ``documents`` returns, repeated ones too, whatever the names of its columns. The automaton stays in the shared folder, as the result reads it.
    """
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id")).alias("n")).first()["n"] or 0
    if total > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {total} bytes of text, more than the {max_benchmark_bytes} that one automaton is built over")
    numbers: dict[str, int] = {}
    texts, owners = [], []
    for r in items.toLocalIterator():
        owners.append(numbers.setdefault(r["item_id"], len(numbers)))
        texts.append(word_hashes(r["text"], ALNUM))
    automaton = build_automaton(texts, owners, window)
    if automaton.nbytes > max_automaton_bytes:
        raise ValueError(f"the automaton has {automaton.nbytes} bytes, more than {max_automaton_bytes}")
    folder = new_path(spark, "automaton")
    _store(automaton, folder)
    scan = _scanner(folder, spark.sparkContext.broadcast(list(numbers)), window)
    found = documents.select(F.struct("*").alias("doc"), scan(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("found"))
    return found.select("doc", "found.*", (F.col("found.n_hit") > 0).alias("contaminated"))
