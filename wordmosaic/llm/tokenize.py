"""Problem 7: the whole corpus as token ids of a public byte-level BPE tokenizer.

Method: corpus-level merge replay. The texts of a chunk of the corpus are cut into
words; each distinct word is laid out once, in one long array of symbols linked to
their neighbours; an inverted index tells where each mergeable pair of symbols
stands; the merges are applied in rank order, each to all its places at once, and
only the two neighbours of a merged symbol change in the index.

Nothing is shuffled: a chunk is a bounded piece of a partition, and words of
earlier chunks of the task are looked up, not replayed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the driver finds the public tokenizer files unless a path is given.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which this family of tokenizers cuts text before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text per chunk, unless one text is longer; distinct words a task remembers.
CHUNK_CHARS = 2_000_000
REMEMBERED = 400_000
#: Words longer than this are replayed, but not remembered.
LONG_WORD = 64


def byte_symbols() -> list[str]:
    """The printable character by which such vocabularies write each byte: itself if printable, else from U+0100 on."""
    shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    names = {b: chr(b) for b in shown}
    for extra, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + extra)
    return [names[b] for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary: ids of the bytes, and for each pair of ids its rank and merged id."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)["model"]
        vocab = model["vocab"]
        self.of_byte = [vocab[s] for s in byte_symbols()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((vocab[left], vocab[right]), (k, vocab[left + right]))

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all merges applied over all words in rank order."""
        rank, of_byte = self.rank, self.of_byte
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym.extend(of_byte[b] for b in w)
            sym.append(-1)  # no pair reaches across words
        n = len(sym)
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in rank:
                places[pair].append(i)
        queue = [(rank[p][0], p) for p in places]
        heapq.heapify(queue)
        while queue:
            k, pair = heapq.heappop(queue)
            at = places.pop(pair, None)
            if not at:
                continue
            a, b = pair
            new = rank[pair][1]
            at.sort()  # within a word from left to right
            touched: set[tuple[int, int]] = set()
            for done, i in enumerate(at):
                j = right[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # merged away meanwhile
                sym[i], sym[j] = new, -2
                after = right[j]
                right[i] = after
                if after < n:
                    left[after] = i
                sooner = False
                before = left[i]
                if before >= 0 and sym[before] >= 0:
                    p = (sym[before], new)
                    if p in rank:
                        places[p].append(before)
                        touched.add(p)
                        sooner |= rank[p][0] < k
                if after < n and sym[after] >= 0:
                    p = (new, sym[after])
                    if p in rank:
                        places[p].append(i)
                        touched.add(p)
                        sooner |= rank[p][0] < k
                if sooner and done + 1 < len(at):  # an earlier merge became possible: it goes first
                    places[pair].extend(at[done + 1 :])
                    touched.add(pair)
                    break
            for p in touched:
                heapq.heappush(queue, (rank[p][0], p))
        out = []
        for s in starts:
            ids, i = [], s
            while sym[i] != -1:
                ids.append(sym[i])
                i = right[i]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def model_text(path: str) -> str:
    """The vocabulary file as the driver reads it; it is sent to the workers, which need no file of their own."""
    return Path(path).read_text(encoding="utf-8")


_BUILT: dict[str, Merges] = {}  # of a worker: one per vocabulary


def merges_of(text: str) -> Merges:
    name = hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
    if name not in _BUILT:
        _BUILT[name] = Merges(text)
    return _BUILT[name]


def encoder(text: str):
    """A function from texts (None among them) to lists of ids by the vocabulary ``text``, remembering words between calls."""
    merges = merges_of(text)
    cut = regex.compile(WORD_PATTERN).findall
    known: dict[str, list[int]] = {}

    def encode(texts: list[str | None]) -> list[list[int]]:
        if len(known) > REMEMBERED:
            known.clear()
        words = [cut(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in known})
        local = dict(zip(fresh, merges.replay([w.encode("utf-8", "replace") for w in fresh]), strict=True)) if fresh else {}
        found = []
        for ws in words:
            ids: list[int] = []
            for w in ws:
                ids += known.get(w) or local[w]
            found.append(ids)
        known.update((w, i) for w, i in local.items() if len(w) <= LONG_WORD)
        return found

    return encode


def chunks(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` characters; a longer text is a run of its own."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _id_pass(model, only_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids = encode(texts[a:b])
                value = pa.array([len(i) for i in ids], pa.int64()) if only_counts else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), value], names=["doc_id", "n_tokens" if only_counts else "ids"])

    return run


def _sent(rows: DataFrame, path: str):
    """The vocabulary as a broadcast: its size is that of a tokenizer, some megabytes."""
    return rows.sparkSession.sparkContext.broadcast(model_text(path))


def token_ids(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every row's text, without special tokens.

    A null and an empty text give an empty list. Strings that look like special tokens are
    ordinary text. Every row is encoded, repeated and null keys too; other columns are
    ignored. No text is cut short: one text longer than a chunk is a chunk of its own.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_id_pass(_sent(rows, tokenizer), False), f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)``: the number of ids :func:`token_ids` gives."""
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_id_pass(_sent(rows, tokenizer), True), f"doc_id {kind}, n_tokens long")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7 over whole ``documents``."""
    return token_ids(spark.read.parquet(f"{d}/documents.parquet"))
