"""Problem 10: abusive, hateful or sexual content.

Method: a counterfactual-regularised classifier. Sentences are the instances: a document is as bad as its worst
sentence, so the reviewed documents train a logistic model by expectation-maximisation (which sentence of a bad
document is bad). For every labelled sentence that names a group, copies with other groups are made and score
changes between them are penalised, so that a neutral mention of a group doesn't raise the score.

Spellings are undone first: joined letters (f u c k, f.u.c.k), digits for letters, masks (f*ck), repeated letters
and single slips, each only towards words of the abusive lexicon, which is learned from the reviews and seeded below.

Defined results: null and empty texts score 0; without reviews of both kinds the seed lexicon alone scores.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that insult, threaten or are sexually explicit in most uses (English, Spanish, French).
SEEDS = (
    "fuck fucking fucker motherfucker shit shithead bullshit bitch bastard asshole dumbass jackass cunt whore slut dick cock pussy tits porn nude naked horny moron idiot imbecile cretin halfwit scumbag retard vermin "
    "stupid bloody wanker twat prick faggot nigger kike spic chink tranny rape "
    "puta puto mierda cabron gilipollas imbecil idiota pendejo joder basura inmunda zorra maricon "
    "merde putain connard salope encule foutre cretin imbecile ordure batard pute"
).split()
# Common words for groups of people; those of the texts are learned (learned_groups).
GROUPS = "women men immigrants migrants refugees foreigners muslims jews christians hindus atheists blacks whites asians arabs africans mexicans gays lesbians mujeres inmigrantes extranjeros gitanos femmes immigres etrangers".split()
_LEET = str.maketrans("0134578@$!€", "oieastbasie")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\n+")
_TOKEN = re.compile(r"[^\s,;:!?\"“”«»()\[\]…]+[!*]*(?=[\s,;:.!?\"“”«»()\[\]…]|$)|[^\s,;:!?\"“”«»()\[\]…]+")
_SINGLE = re.compile(r" [^\W\d_] [^\W\d_](?![^\s.,;:!?\")])")
_SPACED = re.compile(r"(?<![^\s.,;:!?\"(])((?:[^\W\d_] ){2,}[^\W\d_])(?![^\s.,;:!?\")])")


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def sentences(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(text or "")) if s]


def runs_off(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


class Lexicon:
    """Abusive words, and what disguised words mean among them."""

    def __init__(self, words: set[str], known: set[str], names: set[str] = frozenset()):
        self.words, self.known, self.names = set(words), set(known) | set(names), set(names)
        self.by_runs = {runs_off(w): w for w in sorted(words)}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(words):
            self.by_length[len(w)].append(w)
        self.slips = {}
        for w in sorted(words):
            if len(w) >= 4:
                for v in self._one_off(w):
                    if v not in self.words and v not in self.known:
                        self.slips.setdefault(v, w)
        self.signs: dict[str, tuple[str, int]] = {}

    @staticmethod
    def _one_off(w: str):
        near = {"a": "qsz", "e": "wr", "i": "uo", "o": "ip", "u": "yi", "s": "ad", "t": "ry", "n": "bm", "r": "et", "l": "k", "m": "n", "d": "sf", "c": "xv", "b": "vn", "g": "fh", "h": "gj", "k": "jl", "f": "dg", "p": "o", "w": "qe", "y": "tu"}
        for i in range(len(w)):
            if len(w) > 4:  # shorter words without a letter are other words
                yield w[:i] + w[i + 1:]
            for c in near.get(w[i], ""):
                yield w[:i] + c + w[i + 1:]
            if i:
                yield w[:i - 1] + w[i] + w[i - 1] + w[i + 1:]

    def sign(self, token: str) -> tuple[str, int]:
        """(the word a token means, a number as '#', a name as '@'; 1 if it is a word of the lexicon)."""
        if len(self.signs) > 300_000:
            self.signs.clear()
        w, _ = self._read(token)
        hit = self.signs[token] = "#" if any(c.isdigit() for c in w) else "@" if w in self.names else w, int(w in self.words)
        return hit

    def _read(self, token: str) -> tuple[str, bool]:
        bare = token.strip(".'’-_")
        if bare in self.words:
            return bare, False
        if bare in self.known or not bare:
            return bare, False
        if re.fullmatch(r"[^\W_](?:[.\-_*'][^\W_]){2,}", bare):
            bare = re.sub(r"[.\-_*']", "", bare)
        if any(c.isdigit() or c in "@$!€" for c in bare) and any(c.isalpha() for c in bare) or re.fullmatch(r"\d{4,5}", bare) and bare.translate(_LEET) in self.words:
            swapped = bare.translate(_LEET)
            if swapped in self.words or runs_off(swapped) in self.by_runs or swapped in self.slips:
                bare = swapped
        if bare in self.words:
            return bare, True
        if re.search(r"[*#_%+?]", bare):
            mask = re.compile("".join("." if c in "*#_%+?" else re.escape(c) for c in bare.translate(_LEET)))
            if sum(c.isalpha() for c in bare) >= max(2, len(bare) // 2):
                for w in self.by_length.get(len(bare), ()):
                    if mask.fullmatch(w):
                        return w, True
        if (w := self.by_runs.get(runs_off(bare))) and len(bare) > len(w):
            return w, True
        if (w := self.slips.get(bare)):
            return w, True
        return bare, False


def name_words(texts: list[str], keep: set[str]) -> set[str]:
    """Words that are mostly written with a capital inside sentences: names, which must not carry weight."""
    capital, small = Counter(), Counter()
    for text in texts:
        for s in sentences(text):
            if s.upper() != s:
                for w in re.findall(r"(?<=[^\W_] )[^\W\d_]+|(?<=[^\W_], )[^\W\d_]+", s):
                    (capital if w[0].isupper() else small)[plain(w)] += 1
    return {w for w, n in capital.items() if n > 2 * small[w] and w not in keep}


def tokens(sentence: str, lexicon: Lexicon) -> tuple[list[str], int]:
    """Words of a sentence with disguises undone, numbers as '#', names as '@', and how many are lexicon words."""
    text = plain(sentence)
    if _SINGLE.search(text):
        text = _SPACED.sub(lambda m: m[1].replace(" ", ""), text)
    out, bad, memo = [], 0, lexicon.signs
    for t in _TOKEN.findall(text):
        hit = memo.get(t)
        w, is_bad = hit if hit is not None else lexicon.sign(t)
        bad += is_bad
        if w and not (w == "@" and out and out[-1] == "@"):
            out.append(w)
    return out, bad


def features(words: list[str], bad: int) -> list[str]:
    w = ["^", *words, "$"]
    out = set(words)
    out.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    out.update(f"{a} _ {b}" for a, b in zip(w, w[2:]))
    if bad:
        out.add("lexicon")
        if len(words) <= 6:
            out.add("short with lexicon")
    return list(out)


def _swapped(words: list[str], groups: list[list[str]], opening: dict[str, list[int]]) -> list[list[str]]:
    """The sentence with its first group name exchanged for two others; opening has the groups by their first word."""
    for i, w in enumerate(words):
        for k in opening.get(w, ()):
            g = groups[k]
            if words[i:i + len(g)] == g:
                others = [groups[(k + d) % len(groups)] for d in (1, len(groups) // 2)]
                return [words[:i] + o + words[i + len(g):] for o in others if o != g]
    return []


def learned_groups(sentences_of: list[tuple[list[str], bool, bool]], lexicon: set[str], least_slots: int = 3, most_words: int = 2) -> list[list[str]]:
    """Names that fill the same slots in good and in bad documents: what a sentence can be about without being abuse.

    sentences_of holds (words, in a bad document, in a good document). A slot is the pair of words before and the pair
    after; it counts if several names fill it. Names of both kinds of documents that share least_slots slots with
    another such name are groups; words of the lexicon, numbers and single function words are none.
    """
    fills, kinds, plain_words = defaultdict(set), defaultdict(lambda: [0, 0]), Counter(w for ws, _, _ in sentences_of for w in set(ws))
    many = max(20.0, len(sentences_of) / 200)
    for words, bad, good in sentences_of:
        w = ["^", "^", *words, "$", "$"]
        for n in range(1, most_words + 1):
            for i in range(2, len(w) - 1 - n):
                name = tuple(w[i:i + n])
                if any(x in lexicon or x in "#@^$" for x in name) or max(plain_words[x] for x in name) > many and n == 1 or all(plain_words[x] > many for x in name):
                    continue
                kinds[name][0] += bad
                kinds[name][1] += good
                fills[w[i - 2], w[i - 1], w[i + n], w[i + n + 1]].add(name)
    both = {x for x, (bad, good) in kinds.items() if bad >= 3 and good >= 3}
    slots = defaultdict(set)
    for slot, names in fills.items():
        names &= both
        if len(names) > 1:
            for x in names:
                slots[x].add(slot)
    found = []
    for x in sorted(slots):
        if len(slots[x]) >= least_slots and any(len(slots[x] & slots[y]) >= least_slots for y in slots if y != x):
            found.append(list(x))
    return found


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


class AbuseModel:
    """Weights of words, pairs of neighbours ('a b') and pairs with one word between ('a _ b')."""

    def __init__(self, weights: dict[str, float], bias: float, lexicon: Lexicon, threshold: float = 0.5):
        self.weights, self.bias, self.lexicon, self.threshold = weights, bias, lexicon, threshold
        single, near, over = {}, {}, {}
        for f, x in weights.items():
            w = f.split(" ")
            if len(w) == 1 or f == "short with lexicon":
                single[f] = x
            elif len(w) == 2:
                near[w[0], w[1]] = x
            else:
                over[w[0], w[2]] = x
        self.words = {w: i for i, w in enumerate(sorted({*single, *(w for p in (*near, *over) for w in p), "^", "$"}), 1)}
        self.single = np.zeros(len(self.words) + 1)
        for w, x in single.items():
            self.single[self.words[w]] = x
        self.pairs = [self._sorted(near), self._sorted(over)]

    def _sorted(self, of: dict[tuple[str, str], float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([self.words[a] * (len(self.words) + 1) + self.words[b] for a, b in of], np.int64)
        order = np.argsort(keys)
        return keys[order], np.array(list(of.values()))[order] if of else np.zeros(0)

    def __getstate__(self):
        return self.weights, self.bias, self.threshold, sorted(self.lexicon.words), sorted(self.lexicon.known), sorted(self.lexicon.names)

    def __setstate__(self, s):
        self.__init__(s[0], s[1], Lexicon(set(s[3]), set(s[4]), set(s[5])), s[2])

    def sentence_scores(self, texts: list[str]) -> np.ndarray:
        """Scores of many sentences at once: words are ids, pairs of words are keys looked up in sorted arrays."""
        flat, of, extra = [], [], np.zeros(len(texts))
        get, first, last = self.words.get, self.words["^"], self.words["$"]
        lexicon, short = (self.single[get(f, 0)] for f in ("lexicon", "short with lexicon"))
        for k, s in enumerate(texts):
            w, bad = tokens(s, self.lexicon)
            flat.append(first)
            flat += [get(x, 0) for x in w]
            flat.append(last)
            of += [k] * (len(w) + 2)
            if bad:
                extra[k] = lexicon + (short if len(w) <= 6 else 0.0)
        if not texts:
            return extra
        ids, of, n = np.array(flat, np.int64), np.array(of, np.int64), len(self.words) + 1
        z = self.bias + extra
        inner = (ids != first) & (ids != last)
        one = _distinct(of[inner] * n + ids[inner])
        z += np.bincount(one // n, weights=self.single[one % n], minlength=len(texts))
        for step, (keys, weights) in enumerate(self.pairs, 1):
            a, b, k = ids[:-step], ids[step:], of[:-step]
            ok = (k == of[step:]) & (a > 0) & (b > 0)
            key = a[ok] * n + b[ok]
            at = np.searchsorted(keys, key)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == key[hit]
            seen = _distinct(k[ok][hit] * max(1, len(keys)) + at[hit])
            z += np.bincount(seen // max(1, len(keys)), weights=weights[seen % max(1, len(keys))], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def sentence(self, s: str) -> float:
        return float(self.sentence_scores([s])[0])

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: that of its worst sentence; 0 without any."""
        parts = [sentences(t) for t in texts]
        out = np.zeros(len(texts))
        np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(p) for p in parts]), self.sentence_scores([s for p in parts for s in p]))
        return out

    def document(self, text: str | None) -> float:
        return float(self.documents([text])[0])


def _logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int]], n: int, l2: float, fair: float, steps: int, start: np.ndarray) -> np.ndarray:
    """Full-batch Adam on weighted logistic loss + l2 + fair * squared score differences of counterfactual pairs.

    The differences are averaged over the pairs, so that the penalty weighs the same however many there are."""
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1)) if pairs else (np.zeros(0, np.int64),) * 2
    used = weight > 0
    used[a], used[b] = True, True
    place = np.cumsum(used) - 1
    picked = [rows[i] for i in np.flatnonzero(used)]
    y, weight, a, b, m_rows = y[used], weight[used], place[a], place[b], len(picked)
    idx = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    of = np.repeat(np.arange(m_rows), [len(r) for r in picked])
    w, m, v, total = start.copy(), np.zeros(n + 1), np.zeros(n + 1), max(weight.sum(), 1.0)
    for step in range(1, steps + 1):
        z = np.bincount(of, weights=w[idx], minlength=m_rows) + w[n]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = weight * (p - y) / total
        if len(a) and fair:
            d = fair * (z[a] - z[b]) / len(a)
            g += np.bincount(a, weights=d, minlength=m_rows) - np.bincount(b, weights=d, minlength=m_rows)
        grad = np.bincount(idx, weights=g[of], minlength=n + 1)
        grad[n] = g.sum()
        grad[:n] += l2 * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def train(labelled: list[tuple[str, int]], groups: list[str] | None = None, rounds: int = 2, folds: int = 10, fair: float = 0.2, seed_only: bool = False) -> AbuseModel:
    """Fit on (text, label) pairs; labels may be wrong now and then.

    Everything a document is judged by while training comes from the other folds: the first odds, the sentence that
    makes it bad, and the score its threshold is chosen by. So a wrong label can't teach the model its own words.
    Groups that are exchanged for each other are learned from the documents, besides the given ones.
    """
    given = [plain(g).split() for g in (GROUPS if groups is None else groups)]
    bad_docs, good_docs = (sum(y == k for _, y in labelled) for k in (1, 0))
    by_class = [Counter(), Counter()]
    for text, y in labelled:
        by_class[y].update({w for s in sentences(text) for w in re.findall(r"[^\W\d_]+", plain(s))})
    seeds = {plain(w) for w in SEEDS}
    members = {w for g in given for w in g}
    lex = Lexicon(seeds, {w for w, n in by_class[0].items() if n >= max(3, good_docs / 500)} - seeds, name_words([t for t, _ in labelled], seeds | members))
    if seed_only or not bad_docs or not good_docs:
        return AbuseModel({"lexicon": 3.0}, -1.5, lex, 0.5)

    docs: list[list[int]] = []
    index: dict[tuple, int] = {}
    words_of: list[tuple[list[str], int]] = []
    for text, _ in labelled:
        mine = set()
        for s in sentences(text):
            w, bad = tokens(s, lex)
            mine.add(index.setdefault((*w, bad), len(index)))
            if len(index) > len(words_of):
                words_of.append((w, bad))
        docs.append(sorted(mine))
    n_docs, n_sent = len(docs), len(words_of)
    y_doc = np.array([y for _, y in labelled])
    # equal texts stay in one fold
    fold = np.array([zlib.crc32(text.encode()) % folds for text, _ in labelled])
    in_class = np.zeros((2, n_sent), int)
    for mine, y in zip(docs, y_doc):
        in_class[y, mine] += 1
    known = given + [g for g in learned_groups([(w, bool(in_class[1, i]), bool(in_class[0, i])) for i, (w, _) in enumerate(words_of)], lex.words) if g not in given]

    rows_f = [features(w, b) for w, b in words_of]
    number: dict[str, int] = {}
    all_rows = [np.array([number.setdefault(f, len(number)) for f in fs], np.int64) for fs in rows_f]
    seen = np.zeros((folds, 2, len(number)))
    for mine, y, k in zip(docs, y_doc, fold):
        if mine:
            seen[k, y, np.unique(np.concatenate([all_rows[i] for i in mine]))] += 1
    kept = seen.sum((0, 1)) >= 3
    place, n = np.where(kept, np.cumsum(kept) - 1, -1), int(kept.sum())
    seen = seen[:, :, kept]
    rows = [np.sort(x[x >= 0]) for x in (place[r] for r in all_rows)]
    pairs: list[tuple[int, int]] = []
    opening: dict[str, list[int]] = defaultdict(list)
    for k, g in enumerate(known):
        opening[g[0]].append(k)
    for i, (w, b) in enumerate(words_of):
        for other in _swapped(w, known, opening):
            rows.append(np.array(sorted(place[number[f]] for f in features(other, b) if f in number and place[number[f]] >= 0), np.int64))
            pairs.append((i, len(rows) - 1))
    sent_docs = [[d for d in range(n_docs) if fold[d] != k] for k in range(folds)] + [list(range(n_docs))]
    lex_hit, length = np.array([b > 0 for _, b in words_of]), np.array([len(r) for r in rows[:n_sent]])
    flat, of = np.concatenate(rows[:n_sent]), np.repeat(np.arange(n_sent), length)

    good_in = np.zeros((folds, n_sent))
    for mine, y, k in zip(docs, y_doc, fold):
        if not y:
            good_in[k, mine] += 1
    prob, common, counts = np.zeros((folds, n_sent)), np.zeros((folds + 1, n_sent), bool), np.zeros((folds + 1, 2, n_sent))
    for k in range(folds + 1):
        others = seen.sum(0) - (seen[k] if k < folds else 0)
        for d in sent_docs[k]:
            counts[k, y_doc[d], docs[d]] += 1
        bad, good = max(1, sum(y_doc[d] for d in sent_docs[k])), max(1, sum(1 - y_doc[d] for d in sent_docs[k]))
        # held by good documents (but for one) about as often as by bad ones: not what makes a document bad
        common[k] = (counts[k, 0] > 0) & (counts[k, 1] / bad < 3 * (counts[k, 0] - 1) / good)
        if k < folds:
            base = bad / (bad + good)
            # rare features keep near the prior
            odds = np.log((others[1] + 2 * base) / (others[0] + 2 * (1 - base)))
            # a sentence is as bad as the third of its features that speak most against it
            by = np.lexsort((-odds[flat], of))
            top = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) < np.repeat((length + 2) // 3, length)
            score = np.bincount(of[top], weights=odds[flat[by]][top], minlength=n_sent) / np.maximum((length + 2) // 3, 1)
            score = np.where(length > 0, score, -3.0) + 0.5 * lex_hit
            prob[k] = 1 / (1 + np.exp(-3 * (score - 0.3)))

    def fit(k: int, start: np.ndarray, steps: int) -> np.ndarray:
        y_s, w_s = np.zeros(len(rows)), np.zeros(len(rows))
        # a good document whose sentence the other folds call bad is likelier mislabelled
        w_s[:n_sent] = np.minimum(sum(good_in[f] * np.where(prob[f] > 0.8, 0.3, 1.0) for f in range(folds) if f != k), 5)
        for d in sent_docs[k]:
            if y_doc[d] and docs[d]:
                mine, p = np.array(docs[d]), prob[fold[d]][docs[d]]
                open_ = ~common[k][mine]
                for i, q in zip(mine[open_], p[open_]):
                    if q > 0.7 or q > 0.4 and q == p[open_].max():
                        y_s[i] = 1.0
                        w_s[i] += 3.0 * q
        near = [x for x in pairs if counts[k, :, x[0]].any()]
        return _logistic(rows, y_s, w_s, near, n, 5e-5, fair, steps, start)

    weights = [np.zeros(n + 1) for _ in range(folds)]
    for r in range(rounds):
        weights = [fit(k, weights[k], 50 if r == 0 else 25) for k in range(folds)]
        for k in range(folds):
            z = np.bincount(of, weights=weights[k][flat], minlength=n_sent) + weights[k][n]
            prob[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    final = fit(folds, np.mean(weights, axis=0), 40)
    top = np.array([prob[k][mine].max() if mine else 0.0 for mine, k in zip(docs, fold)])
    names = list(number)
    by_place = [names[i] for i in np.flatnonzero(kept)]
    model = AbuseModel({f: float(x) for f, x in zip(by_place, final) if abs(x) > 1e-3}, float(final[n]), lex, best_cut(top, y_doc))
    model.groups = known
    return model


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1 of scores that each come from a model without the document; ties go to their middle."""
    cuts = np.arange(0.2, 0.96, 0.01)
    f1 = np.array([2 * ((scores > c) & (y == 1)).sum() / max(1, (scores > c).sum() + (y == 1).sum()) for c in cuts])
    best = cuts[f1 >= f1.max() - 0.002]
    return float(best[len(best) // 2])


def labelled_sample(documents: DataFrame, reviews: DataFrame, most: int = 6000) -> list[tuple[str, int]]:
    """Majority verdicts of at most `most` reviewed documents, in hash order of their id; ties are left out."""
    verdict = (reviews.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("share"))
               .where("share <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", (F.col("share") > 0.5).cast("int").alias("label")))
    rows = documents.select("doc_id", "text").join(F.broadcast(verdict), "doc_id").select("doc_id", "text", "label").distinct().collect()  # at most `most` rows
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "")) if r["text"]]


def scores(documents: DataFrame, reviews: DataFrame, groups: list[str] | None = None, most_labelled: int = 6000) -> tuple[DataFrame, float]:
    """((doc_id, source, score), threshold): one row per document."""
    model = train(labelled_sample(documents, reviews, most_labelled), groups)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by most_labelled

    def run(batches):
        m = shared.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": m.documents(list(pdf["text"]))})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double"), model.threshold


def p10_found(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    s, threshold = scores(documents, reviews)
    return s.where(F.col("score") > threshold).select("doc_id")


def p10_rates(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """source, n_documents, n_abusive, rate."""
    s, threshold = scores(documents, reviews)
    bad = F.sum((F.col("score") > threshold).cast("long"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), bad.alias("n_abusive"), (bad / F.count(F.lit(1))).alias("rate"))
