"""Problem 8: filling fixed-capacity containers with items.

Method: Karmarkar-Karp multiway differencing. A block of texts is to be cut into m windows; every text starts as a
partial partition of its own, and the two partial partitions of the largest spread are merged with opposing
imbalances until one is left, which gives windows of nearly equal size. m begins at the least number that could
hold the block and rises while a window exceeds the capacity.

Blocks are runs of rows within a partition, so nothing is shuffled and no block grows with the data. Only texts above
the capacity are split: into full containers and a rest, which is packed like any other text.

Defined results: null and empty texts have no tokens and get a container like others; repeated rows are packed each.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of the byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """A tiktoken encoding from a vocabulary file, once for each worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indexes of sizes in m windows of nearly equal sums."""
    count = itertools.count()
    # a partial partition keeps only its non-empty windows, as (sum, indexes), largest first
    heap = [(-s, next(count), [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            merged = a + b
        else:
            # both padded to m windows: the largest of one meets the smallest of the other
            merged, lack_a, lack_b = [], m - len(a), m - len(b)
            merged += a[:lack_b] + b[:lack_a]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[lack_b:], reversed(b[lack_a:]))]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == m else 0
        heapq.heappush(heap, (-(merged[0][0] - low), next(count), merged))
    windows = [list(x[1]) for x in heap[0][2]] if heap else []
    return windows + [[] for _ in range(m - len(windows))]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows none of which exceeds the capacity; every size must be at most the capacity."""
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        windows = differencing(sizes, m)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        m += 1


def containers(documents: DataFrame, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", capacity: int = 2048, block: int = 1000) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id): one row per document, several for split ones.

    tokenizer is the path of a public vocabulary file that every executor can read. block is the number of texts
    packed together: more give less unused space (under one container a block) and take longer.
    """
    if capacity < 1 or block < 1:
        raise ValueError("capacity and block must be positive")

    def run(batches):
        from pyspark import TaskContext

        enc = encoding(tokenizer)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        number = itertools.count()
        held: list[tuple] = []

        def emit():
            rows = []
            items: list[tuple] = []
            for doc, n in held:
                piece = 0
                while n - piece * capacity > capacity:
                    rows.append((doc, piece, piece * capacity, capacity, base + next(number)))
                    piece += 1
                items.append((doc, piece, piece * capacity, n - piece * capacity))
            for w in pack([x[3] for x in items], capacity):
                c = base + next(number)
                rows += [(*items[i], c) for i in w]
            held.clear()
            return pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "n_tokens", "container_id"])

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                held.append((doc, len(enc.encode_ordinary(text)) if text else 0))
                if len(held) >= block:
                    yield emit()
        if held:
            yield emit()

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, first_token int, n_tokens int, container_id long")


def p8_containers(documents: DataFrame) -> DataFrame:
    return containers(documents)


def p8_fill(documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: n_documents, n_tokens, n_containers, and the share of their capacity that is used."""
    c = containers(documents, capacity=capacity)
    by = c.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.sum((F.col("piece") == 0).cast("long")).alias("docs"))
    return by.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"))
