"""Problem 9: evaluation texts leaking into training text.

Method: an FM-index for each shard of the corpus. A shard is a run of whole documents of about shard_words words;
its words are the symbols. Test phrases of phrase_words words are searched backwards through wavelet-matrix ranks,
their occurrences located by sampled suffix positions. Occurrences on nearly one diagonal join to pieces, the
pieces of a document and item give the covered item words, and covered stretches merge to removal spans.

Words that no test item has only break phrases; each run of them is one separator symbol of its own. Phrases of at
least three items, or in more than stock_share of the distinct texts, are stock and do not count, unless they belong
to an exact run of LONG_RUN words of the item in the document: a passage of that length counts however many texts or
items hold it.

Defined results: null and empty texts have no leak; repeated rows each give theirs; a repeated item_id counts as
one item with the texts joined; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetloom.session import staged

#: Words of an exact run that counts even where many texts or three items hold it.
LONG_RUN = 25
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence of non-negative keys, by prefix doubling."""
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step or None] = rank[step:] + 1 if step < n else 0
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        s = both[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """Ranks of symbols, for many symbols and positions at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, s = [], symbols
        for b in range(bits - 1, -1, -1):
            one = (s >> b) & 1
            ranks = np.zeros(len(s) + 1, np.int32)
            np.cumsum(one, out=ranks[1:])
            self.levels.append((b, ranks, len(s) - int(ranks[-1])))
            s = np.concatenate((s[one == 0], s[one == 1]))

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c[i] stands before position at[i]."""
        start, end = np.zeros(len(c), np.int64), at.astype(np.int64)
        for b, ranks, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            start = np.where(one, zeros + ranks[start], start - ranks[start])
            end = np.where(one, zeros + ranks[end], end - ranks[end])
        return end - start


class WordIndex:
    """FM-index of a sequence of word ids; 0 is a separator, which never matches."""

    def __init__(self, ids: np.ndarray, n_words: int, sample: int = 8):
        if not len(ids) or ids[-1]:
            ids = np.append(ids, 0)  # the last word needs a suffix after it
        n = len(ids)
        separators = ids == 0
        n_sep = int(separators.sum())
        keys = ids.astype(np.int64) + n_sep
        keys[separators] = np.arange(n_sep)  # each separator differs from every other
        sa = suffix_array(keys)
        self.n = n
        self.bwt = np.concatenate(([0], ids[:-1]))[sa].astype(np.int32)
        self.first = n_sep + np.concatenate(([0, 0], np.cumsum(np.bincount(ids[~separators], minlength=n_words + 1)[1:])))
        self.ranks = WaveletMatrix(self.bwt.astype(np.int64), max(1, int(n_words).bit_length()))
        # positions after a separator end the walk of locate, besides every sample-th one; only theirs are kept
        self.known = (sa % sample == 0) | (self.bwt == 0)
        self.place = sa[self.known].astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(self.known))).astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of suffixes that begin with each row of phrases."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            low, high = self.first[c] + self.ranks.rank(c, low), self.first[c] + self.ranks.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.known[at]
            out[open_[done]] = self.place[self.before[at[done]]] + steps
            at, open_ = at[~done], open_[~done]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self.ranks.rank(c, at)
            steps += 1
        return out


class TestPhrases:
    """The test items as word ids, and their distinct phrases with the places they come from."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocab = k, {}
        joined: dict[int, list[str]] = defaultdict(list)
        for i, text in items:
            joined[i] += words(text)
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in sorted(joined.items()):
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            for p in range(len(ids) - k + 1):
                self.places[tuple(ids[p:p + k])].append((i, p))
        self.phrases = np.array(sorted(self.places), np.int64).reshape(-1, k)
        self.from_ = [self.places[tuple(p)] for p in self.phrases.tolist()]


def _index_shards(shared, shard_words: int):
    """mapInPandas function over broadcast test phrases: (doc_id, text) to (doc_id, text_hash, phrase ids, word positions) of documents with hits."""

    def hits(items: TestPhrases, docs: list, texts: list[str], ids: list[int], at: list[int], doc_of: list[int]):
        if not ids or not len(items.phrases):
            return None
        index = WordIndex(np.array(ids, np.int64), len(items.vocab))
        low, high = index.search(items.phrases)
        n = high - low
        if not n.sum():
            return None
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place = index.locate(rows)
        out = pd.DataFrame({"doc": np.array(doc_of)[place], "phrase": which, "at": np.array(at)[place]}).sort_values(["doc", "at", "phrase"])
        groups = [(d, g["phrase"].tolist(), g["at"].tolist()) for d, g in out.groupby("doc")]
        return pd.DataFrame({"doc_id": [docs[d] for d, _, _ in groups], "text": [texts[d] for d, _, _ in groups], "phrases": [p for _, p, _ in groups], "places": [a for _, _, a in groups]})

    def run(batches):
        import xxhash

        items = shared.value
        docs, texts, ids, at, doc_of = [], [], [], [], []

        def finish():
            out = hits(items, docs, texts, ids, at, doc_of)
            if out is not None:
                out["text"] = [np.int64(np.uint64(xxhash.xxh3_64_intdigest(t))) for t in out["text"]]
                return out.rename(columns={"text": "text_hash"})
            return None

        get = items.vocab.get
        for pdf in batches:
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                if not text:
                    continue
                docs.append(d)
                texts.append(text)
                me, last = len(docs) - 1, 1
                for p, w in enumerate(words(text)):
                    x = get(w, 0)
                    if x or last:
                        ids.append(x)
                        at.append(p)
                        doc_of.append(me)
                    last = x
                ids.append(0)
                at.append(-1)
                doc_of.append(me)
                if len(ids) >= shard_words:
                    if (out := finish()) is not None:
                        yield out
                    docs, texts, ids, at, doc_of = [], [], [], [], []
        if (out := finish()) is not None:
            yield out

    return run


def pieces(points: list[tuple[int, int]], k: int, gap: int = 7, drift: int = 4) -> list[list[int]]:
    """Joins (word of the document, word of the item) hits on nearly one diagonal: [doc from, to, item from, to)."""
    out: list[list[int]] = []
    open_: list[list[int]] = []
    for q, p in sorted(points):
        open_ = [x for x in open_ if q - x[1] <= k + gap]
        for x in reversed(open_):
            dq, dp = q - x[1], p - x[3]
            if 0 <= dq and 0 <= dp <= k + gap and abs(dq - dp) <= drift:
                x[1], x[3] = q, p
                break
        else:
            open_.append([q, q, p, p])
            out.append(open_[-1])
    return [[a, b + k, c, d + k] for a, b, c, d in out]


def in_long_runs(points: list[tuple[int, int]], k: int, least: int = LONG_RUN) -> set[tuple[int, int]]:
    """Hits (word of the document, word of the item) of k words that belong to an exact run of least words."""
    out: set[tuple[int, int]] = set()
    run: list[tuple[int, int]] = []
    for q, p in sorted(set(points), key=lambda x: (x[0] - x[1], x[0])):
        if not run or (q - 1, p - 1) != run[-1]:
            run = []
        run.append((q, p))
        if len(run) + k - 1 == least:
            out.update(run)
        elif len(run) + k - 1 > least:
            out.add((q, p))
    return out


def union_length(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def phrase_hits(documents: DataFrame, eval_items: DataFrame, phrase_words: int, shard_words: int, most_chars: int) -> tuple[DataFrame, TestPhrases]:
    """((doc_id, text_hash, phrases, places), the test phrases): where the phrases of the test set stand.

    The test set comes to the driver and is broadcast; it may have most_chars characters, and more is refused: give it
    in parts then. The corpus is only read."""
    named = eval_items.where(F.col("item_id").isNotNull())
    chars = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > most_chars:
        raise ValueError(f"the test set has {chars} characters, more than {most_chars}: search it in parts")
    items = TestPhrases([(r[0], r[1]) for r in named.select("item_id", "text").collect()], phrase_words)
    shared = documents.sparkSession.sparkContext.broadcast(items)
    found = documents.select("doc_id", "text").mapInPandas(_index_shards(shared, shard_words), "doc_id long, text_hash long, phrases array<int>, places array<int>")
    return staged(found, "phrase-hits"), items


def leaks(documents: DataFrame, eval_items: DataFrame, phrase_words: int = 4, least_words: int = 16, stock_share: float = 0.01, shard_words: int = 400_000, most_chars: int = 50_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, spans ARRAY<STRUCT<first, last>>): documents that carry an item's wording.

    least_words counts item words in pieces beyond stock phrases and altered edges. A passage of 25 words whose pieces
    hide no more than a quotation's worth of words (nine) so keeps 16; a quotation has nine at most.
    """
    spark = documents.sparkSession
    found, items = phrase_hits(documents, eval_items, phrase_words, shard_words, most_chars)
    n_texts = documents.where("text <> ''").select(F.xxhash64("text").alias("h")).distinct().count()
    often = found.select("text_hash", F.explode(F.array_distinct("phrases")).alias("phrase")).distinct().groupBy("phrase").count().where(F.col("count") > max(stock_share * n_texts, 10))
    stock = {r[0] for r in often.select("phrase").collect()}  # at most the phrases of the test set
    stock |= {j for j, places in enumerate(items.from_) if len({i for i, _ in places}) >= 3}
    shared = spark.sparkContext.broadcast((items.from_, stock))

    def cover(batches):
        from_, stock = shared.value
        for pdf in batches:
            out = []
            for doc, phrases, places in zip(pdf["doc_id"], pdf["phrases"], pdf["places"]):
                by_item, common = defaultdict(list), defaultdict(set)
                for j, q in zip(phrases, places):
                    for i, p in from_[j]:
                        by_item[i].append((int(q), p))
                        if j in stock:
                            common[i].add((int(q), p))
                for i, points in by_item.items():
                    if common[i]:
                        long_ = in_long_runs(points, phrase_words)
                        points = [x for x in points if x not in common[i] or x in long_]
                    found = pieces(points, phrase_words)
                    n = union_length([(c, d) for _, _, c, d in found])
                    if n >= least_words:
                        out.append((doc, i, n, [(a, b) for a, b, _, _ in found]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "spans"])

    return found.mapInPandas(cover, "doc_id long, item_id long, n_words int, spans array<struct<first:int,last:int>>")


def p9_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, eval_items).select("doc_id", "item_id").distinct()


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last) to doc_id, first_word, last_word (excluded), item_ids: spans that touch are one."""
    by = Window.partitionBy("doc_id").orderBy("first", "last", "item_id")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (before.isNull() | (F.col("first") > before)).cast("int")).withColumn("stretch", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("doc_id", "stretch").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("item_ids")).drop("stretch")


def p9_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Merged removal spans: doc_id, first_word, last_word (excluded), item_ids."""
    return merge_spans(leaks(documents, eval_items).select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", "s.first", "s.last"))


def p9_phrases(documents: DataFrame, eval_items: DataFrame, phrase_words: int = 4) -> DataFrame:
    """What the index finds before any rule: doc_id, n_hits (places of test phrases), n_phrases (different ones)."""
    found, _ = phrase_hits(documents, eval_items, phrase_words, 400_000, 50_000_000)
    return found.select("doc_id", F.size("places").cast("long").alias("n_hits"), F.size(F.array_distinct("phrases")).cast("long").alias("n_phrases"))
