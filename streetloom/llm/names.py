"""Problem 6: variant spellings of names typed by people.

Method: pigeonhole segment join. The distinctive words of a name (a surname, or what is left of a firm's name without
the words of its trade) are cut into 2k+1 segments (k edits, each of which may be an exchange across a cut); every name
looks up position-shifted substrings in the inverted index of segments, and a banded edit distance verifies the
pairs. k is one more where one of the words has LONG letters. Trade, given name, city and region must agree as far as
they are known. Words of trades and whole trades are learned from the names themselves, beside a list of public ones.

Names that say too little alone (no city, only an initial, a nickname of two given names) join an entity only if
there is one they fit. Entities are connected components of the verified links.

Joins on segments, cores and entities have written tables on both sides, so adaptive execution can split a hot key.
Every step is a written table and no join is a broadcast: a plan of the whole linkage, planned anew after each of its
stages, and broadcasts of what looked small in its file would be what the driver's memory is spent on.

Defined results: a null or empty name, or one without a letter or digit, matches nothing; names of under three letters
or in another script match only the same spelling; repeated rows are mentions of the same entity.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from streetloom.operators.components import components
from streetloom.session import staged

# Words for kinds of business, usual short forms, words that say nothing, titles, and given names with
# their nicknames. Which trades there are is learned from the names (learned_reader).
TRADE_WORDS = """accounting agency animal apartments appliance architects associates attorneys auto automotive bakery bank bar barber baseball behavioral body books bookstore brewery builders cabinets cafe cardiology care carpet
carpentry cars catering center chemical child chiropractic church cleaners cleaning clinic college collision communications community company computers concrete construction consulting contractors counseling credit dance
daycare deli dental dentistry dermatology design diagnostics diner distributors drug drywall electric electrical electronics engineering equipment eye family farm feed fence finance financial fire fitness floor flooring florist
food foods foundation freight funeral furniture garage garden gas glass grill grocery group gym hair hardware health heating home homes hospice hospital hotel imaging industries inn institute insurance interiors internet
jewelers laboratory landscaping laundry law learning legal library living locksmith logistics lumber machine management manufacturing market martial massage masonry medical medicine memorial mental mortgage motel motors moving
museum music nails nursery nursing nutrition office optical optometry orthodontics orthopedic painting partners pawn pediatric pest pet pharmacy photography physical physicians pizza plaza plumbing pool preschool primary
printing products property psychology publishing radiology realty records recycling rehabilitation remodeling rental repair research restaurant roofing salon school security senior service services shipping shoes shop
siding signs software solutions spa specialists sports station storage store studio supply surgery surgical systems tailor tanning tax taxi technologies theater therapy tile tire tires tools towing toys trading
training transport travel tree trucking university upholstery urgent veterinary video vision warehouse wellness welding wholesale window windows wine womens yoga""".split()
SHORT = {
    "ctr": "center", "centre": "center", "cntr": "center", "svcs": "services", "svc": "services", "serv": "services", "hlth": "health", "assoc": "associates", "assocs": "associates", "hosp": "hospital", "vet": "veterinary", "med": "medical", "fam": "family",
    "ins": "insurance", "mem": "memorial", "mgmt": "management", "mgt": "management", "prop": "property", "peds": "pediatric", "pediatrics": "pediatric", "ortho": "orthopedic", "lab": "laboratory", "labs": "laboratory", "phys": "physical", "behav": "behavioral",
    "comm": "community", "grp": "group", "inst": "institute", "co": "company", "acctg": "accounting", "acct": "accounting", "pharm": "pharmacy", "rx": "pharmacy", "hdwe": "hardware", "sup": "supply", "cln": "clinic", "frt": "freight", "agcy": "agency", "sr": "senior", "ther": "therapy", "lrng": "learning",
    "constr": "construction", "mfg": "manufacturing", "equip": "equipment", "elec": "electric", "rehab": "rehabilitation", "univ": "university", "bros": "brothers", "rest": "restaurant", "whse": "warehouse", "engr": "engineering", "tech": "technologies", "intl": "international", "natl": "national",
}
EMPTY = {"the", "of", "and", "inc", "llc", "pc", "ltd", "corp", "incorporated", "at", "for", "l", "p", "a"}
TITLES = {"md", "do", "dds", "dpm", "od", "dr", "dmd", "dvm", "phd", "rn", "np", "pa", "mr", "mrs", "ms", "jr", "iii"}
GIVEN = {
    "aaron": "", "abigail": "abby gail", "adam": "", "albert": "al bert", "alexander": "alex alec sandy", "alexandra": "alex lexi sandra sandy", "alfred": "alf fred", "alice": "", "amanda": "mandy", "andrew": "andy drew", "angela": "angie", "anna": "annie", "anthony": "tony ant", "arthur": "art", "barbara": "barb babs",
    "benjamin": "ben benny", "bernard": "bernie", "beverly": "bev", "brian": "", "carlos": "", "carolyn": "carol", "catherine": "cathy cat", "charles": "charlie chuck chas", "christine": "chris tina chrissy", "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie",
    "dennis": "", "dolores": "lola", "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora", "elizabeth": "beth betty liz eliza lizzie", "emily": "em", "eric": "", "eugene": "gene", "evelyn": "evie", "florence": "flo", "frances": "fran frannie",
    "francisco": "paco frank pancho cisco", "franklin": "frank", "frederick": "fred freddie", "gabriel": "gabe", "george": "", "gerald": "gerry jerry", "gloria": "", "gregory": "greg gregg", "guadalupe": "lupe lupita", "harold": "hal harry", "heather": "", "helen": "nell", "henry": "hank harry", "howard": "howie", "isabel": "bella izzy",
    "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "jesus": "chuy", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe pepe joey", "joshua": "josh", "judith": "judy", "karen": "", "katherine": "kate kathy kit katie kathie",
    "kenneth": "ken kenny", "kevin": "", "kimberly": "kim", "larry": "", "lawrence": "larry", "leonard": "leo lenny len", "linda": "", "lisa": "", "louis": "lou louie", "margaret": "maggie meg peggy marge", "maria": "", "mark": "", "martha": "", "martin": "marty", "mary": "molly polly", "matthew": "matt", "melissa": "missy", "michael": "mike mikey",
    "michelle": "shelly", "nancy": "nan", "nathaniel": "nate nathan", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "paul": "", "peter": "pete", "philip": "phil", "rachel": "", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob bobby rob robbie bert",
    "roger": "", "ronald": "ron ronnie", "ruth": "", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sally sadie", "scott": "", "sharon": "", "stephanie": "steph", "stephen": "steve stevie", "susan": "sue suzie susie", "teresa": "terry tess", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "valerie": "val", "victor": "vic", "victoria": "tori vicky vicki", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt", "william": "bill billy will willy liam",
}
#: Letters from which a word may carry one edit more.
LONG = 8
_PLACE = {"st": "saint", "ste": "saint", "ft": "fort", "mt": "mount", "n": "north", "s": "south", "e": "east", "w": "west", "hts": "heights", "jct": "junction", "vly": "valley", "lk": "lake", "spgs": "springs", "pk": "park", "fls": "falls", "lndg": "landing", "bch": "beach", "nw": "new"}


def fold(text: str | None) -> str:
    t = (text or "").lower()
    if t.isascii():
        return t
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return t.replace("’", "'").replace("ß", "ss").replace("œ", "oe").replace("æ", "ae").replace("ø", "o").replace("ł", "l").replace("þ", "th").replace("ð", "d")


def city_key(city: str | None) -> str:
    words = re.sub(r"[^a-z ]+", " ", fold(city).replace("'", "")).split()
    return "" if words == ["unknown"] else "".join(_PLACE.get(w, w) for w in words)


def osa(a: str, b: str, most: int) -> int:
    """Banded edit distance with exchanges; most + 1 when it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur, low, high = [i] + [most + 1] * len(b), max(1, i - most), min(len(b), i + most)
        for j in range(low, high + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cur[j] = min(cur[j], prev2[j - 2] + 1)
        if min(cur[low - 1:high + 1]) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


def without(word: str, most: int) -> set[str]:
    """word with up to most letters left out."""
    out = last = {word}
    for _ in range(most):
        last = {x[:i] + x[i + 1:] for x in last for i in range(len(x))}
        out = out | last
    return out


class SlipIndex:
    """Finds the words within their number of edits of a typed word: both lose as many letters to become the same."""

    def __init__(self, most: dict[str, int]):
        self.most = most
        self.by_rest: dict[str, list[str]] = {}
        for w, k in sorted(most.items()):
            for x in without(w, k):
                self.by_rest.setdefault(x, []).append(w)

    def find(self, typed: str) -> list[tuple[int, str]]:
        near = {w for x in without(typed, max(self.most.values(), default=0)) for w in self.by_rest.get(x, ())}
        return sorted((d, w) for w in near if (d := osa(typed, w, self.most[w])) <= self.most[w])


def name_words(name: str | None) -> list[str]:
    """Words of a name in small letters: dotted initials joined, possessives and apostrophes off."""
    text = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?\.?", lambda m: m[0].replace(".", ""), fold(name))  # M.D., L.L.C.
    text = re.sub(r"\bl l c\b", "llc", re.sub(r"'s\b", "", text).replace("'", ""))
    return [w for w in re.split(r"[^a-z0-9]+", text) if w]


class NameReader:
    """Splits a typed name into kind (trade or person), distinctive words, given names and middle initial.

    generic holds words of trades beside TRADE_WORDS, trades the word orders of whole trades with their frequency."""

    def __init__(self, generic: list[str] | None = None, trades: dict[str, int] | None = None, given: dict[str, str] | None = None):
        given = given or GIVEN
        nicknames = {n for nicks in given.values() for n in nicks.split()} | set(given)
        self.known = {*TRADE_WORDS, *SHORT.values(), *(w for w in generic or () if w not in nicknames)}
        orders: dict[frozenset, tuple[int, str]] = {}
        total: dict[frozenset, int] = {}
        for order, n in sorted((trades or {}).items()):
            if self.known.issuperset(order.split()):
                ws = frozenset(order.split())
                total[ws] = total.get(ws, 0) + n
                orders[ws] = max(orders.get(ws, (0, "")), (n, order))
        self.initials: dict[str, str] = {}
        for ws, n in sorted(total.items(), key=lambda x: (-x[1], sorted(x[0]))):
            for form in (orders[ws][1], orders[ws][1] + " llc"):
                k = "".join(w[0] for w in form.split())
                if len(k) >= 2 and len(form.split()) > 1:
                    self.initials.setdefault(k, " ".join(sorted(ws)))
        # frequent initials are no words of their own
        self.known -= self.initials.keys() - set(TRADE_WORDS)
        self.slips = SlipIndex({w: 2 if len(w) >= 7 else 1 for w in self.known if len(w) >= 4})
        self.short_slips = SlipIndex({k: 1 for k in SHORT if len(k) >= 4})
        # a part of a trade that is more frequent as a whole is no trade of its own
        self.trades = {ws: n for ws, n in total.items() if ws <= self.known and not any(ws < o and m >= n for o, m in total.items())}
        self.learned = {w for ws in self.trades for w in ws}
        self.initials = {k: self.kind(t.split()) for k, t in self.initials.items()}
        self.given: dict[str, tuple[str, ...]] = {g: (g,) for g in given}
        for g, nicks in given.items():
            for n in nicks.split():
                self.given[n] = tuple(sorted({*self.given.get(n, ()), g}))
        self.given_slips = SlipIndex({g: 2 if len(g) >= 7 else 1 for g in given if len(g) >= 4})
        self.nick_slips = SlipIndex({n: 1 for n in self.given if len(n) >= 4})
        self.memo: dict[str, list[str]] = {}
        self.given_memo: dict[str, tuple[str, ...]] = {}

    def trade_words(self, w: str) -> list[str]:
        """The trade words that w is (one), or is the nearest slip of."""
        if w not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[w] = self._trade_words(w)
        return self.memo[w]

    def _trade_words(self, w: str) -> list[str]:
        if w in SHORT or w in self.known:
            return [SHORT.get(w, w)]
        if len(w) < 4:
            return []
        near = [(d, x) for d, x in self.slips.find(w) if len(x) >= 5 or x[0] == w[0]]
        near += [(1, SHORT[k]) for _, k in self.short_slips.find(w)]
        # words of the learned trades first
        near = [x for x in near if x[1] in self.learned] or near
        return sorted({x for d, x in near if d == min(near)[0]})

    def _meant(self, options: list[list[str]]) -> list[str]:
        """One word of each list: where there are several, the one that fits a trade best beside the sure ones."""
        sure = {o[0] for o in options if len(o) == 1}
        score = lambda x: max((len((sure | {x}) & ws) / len(sure | {x} | ws) for ws in self.trades), default=0.0)
        return [o[0] if len(o) == 1 else max(o, key=lambda x: (score(x), x)) for o in options]

    def kind(self, words: list[str]) -> str:
        """The trade a set of trade words stands for: the most similar one of at least half its words, or the only one
        that has them all; else the words themselves."""
        ks = frozenset(words)
        best = max(((len(ks & ws) / len(ks | ws), n, sorted(ws)) for ws, n in self.trades.items() if ks & ws), default=None)
        if best and (best[0] >= 0.5 or sum(ks <= ws for ws in self.trades) == 1 and ks <= set(best[2])):
            return " ".join(best[2])
        return " ".join(sorted(ks))

    def tags(self, kind: str, given: list[str]) -> list[str]:
        """What names of the same kind have in common: the trade if it is a known one, else its words."""
        if kind == "person":
            return [f"person|{given[0][:1] if given else ''}"]
        return [kind] if not kind or frozenset(kind.split()) in self.trades else kind.split()

    def given_name(self, w: str) -> tuple[str, ...]:
        if w in self.given:
            return self.given[w]
        if w not in self.given_memo:
            if len(self.given_memo) > 300_000:
                self.given_memo.clear()
            found = [(d, g) for d, g in self.given_slips.find(w) if w[:1] == g[:1] and d <= 1] or [(d, g) for d, g in self.given_slips.find(w) if d == 2 and len(w) >= 6 and w[-1:] == g[-1:]]
            near = [g for _, g in found]
            if not near and len(w) >= 4:  # a slip in a nickname; in a short one only an exchange or a letter more
                near = [x for _, n in self.nick_slips.find(w) if n[0] == w[0] and (len(n) > 4 or len(w) > len(n) or sorted(w) == sorted(n)) for x in self.given[n]]
            nearest = min((osa(w, g, 2) for g in near), default=0)
            self.given_memo[w] = tuple(sorted({x for g in near if osa(w, g, 2) == nearest for x in self.given[g]}))
        return self.given_memo[w]

    def read(self, name: str | None) -> tuple[str, list[str], list[str], str] | None:
        """(kind, distinctive words, given, middle): kind is a trade, 'person' or ''; given is empty for firms."""
        comma = "," in re.sub(r",\s*(m\.?d|d\.?o|d\.?d\.?s|d\.?p\.?m|o\.?d|inc|llc|l\.l\.c|pc)\.?\s*$", "", fold(name))
        words = name_words(name)
        if not words:
            return None
        titled = any(w in TITLES for w in words)
        words = [w for w in words if w not in TITLES]
        trade = {w: self.trade_words(w) for w in words if w not in EMPTY and not (w in self.given and not self.known & {w})}
        trade = {w: o for w, o in trade.items() if o}
        trade = dict(zip(trade, self._meant(list(trade.values()))))
        known = list(trade.values())
        initials = [w for w in words if w in self.initials and len(w) >= 2 and not trade.get(w)]
        if not titled and (known or initials):
            rest = [w for w in words if w not in EMPTY and not trade.get(w) and w not in initials and len(w) > 1]
            if not rest:  # every word is one of a trade: the first is the name
                first = [w for w in words if w not in EMPTY][:1]
                rest, known = first, [t for w, t in trade.items() if t and w not in first] or known
            kind = self.kind(known) if known else self.initials[initials[0]]
            # with the trade known, a word that is nearly a missing one of it is that word
            missing = [t for t in kind.split() if t not in known and len(t) >= 5]
            slips = [w for w in rest if any(osa(w, t, 3) <= (2 if len(t) < 8 else 3) for t in missing)]
            if len(slips) < len(rest):
                rest = [w for w in rest if w not in slips]
            return kind, sorted(set(rest)), [], ""
        long_ = [w for w in words if len(w) > 1 and w not in EMPTY]
        single = [w for w in words if len(w) == 1 and w not in ("l", "p", "a") or len(w) == 1 and len(words) <= 3]
        found = [(w, g) for w in long_ if (g := self.given_name(w))]
        if len(found) == len(long_) and len(found) > 1:  # the surname looks like a given name: it is the longest
            found = [x for x in found if x[0] != max(long_, key=len)]
        others = [w for w in long_ if w not in [x for x, _ in found[:1]]]
        if not others:
            return None if not long_ else ("", sorted(set(long_)), [], "")
        core = max(others, key=len)
        if found and (titled or len(long_) <= 3):
            return "person", [core], list(found[0][1]), single[0] if single else ""
        if single and (titled or len(long_) == 1):
            return "person", [core], [single[0]], ""
        extra = [w for w in others if w != core]
        if titled or len(extra) == 1 and comma:
            return "person", [core], extra[:1], ""
        return "", sorted(set(long_)), [], ""


def learned_reader(names: DataFrame, least_share: int = 500, trade_share: int = 2000) -> NameReader:
    """A reader with the trade words and trades of the names (a DataFrame of one column).

    A word is generic if at least one distinct name in least_share has it, beside many different words: what names an
    entity stands beside the same few words however often. At most least_share words for each word of a name come to
    the driver, and at most trade_share trades."""
    distinct = staged(names.toDF("name").where("name is not null").select(F.lower("name").alias("name")).distinct(), "distinct-names")
    total = distinct.count()

    def pairs(batches):
        for pdf in batches:
            rows = []
            for n in pdf["name"]:
                ws = sorted({w for w in name_words(n) if len(w) > 2 and w not in EMPTY and w not in TITLES and not w.isdigit()})
                rows += [(w, x, int(k == 0)) for w in ws for k, x in enumerate([y for y in ws if y != w] or [""])]
            yield pd.DataFrame(rows, columns=["w", "beside", "one"])

    counted = distinct.mapInPandas(pairs, "w string, beside string, one int").groupBy("w").agg(F.sum("one").alias("n"), F.approx_count_distinct("beside").alias("beside"))
    generic = [r["w"] for r in counted.where((F.col("n") >= max(12, total / least_share)) & (F.col("beside") >= 0.1 * F.col("n"))).collect()]
    words = NameReader(generic).known

    def orders(batches):
        for pdf in batches:
            out = []
            for n in pdf["name"]:
                ws = [SHORT.get(w, w) for w in name_words(n) if w not in EMPTY and SHORT.get(w, w) in words]
                out.append(" ".join(dict.fromkeys(ws)))
            yield pd.DataFrame({"trade": out})

    trades = distinct.mapInPandas(orders, "trade string").where("trade <> ''").groupBy("trade").count().where(F.col("count") >= max(2, total / trade_share))
    return NameReader(generic, {r[0]: r[1] for r in trades.collect()})


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a word as even as can be, longer ones last."""
    small, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = small + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def index_keys(word: str, edits: int) -> list[str]:
    parts = 2 * edits + 1
    return [f"{edits}:{i}:{len(word)}:{word[a:a + n]}" for i, (a, n) in enumerate(segments(len(word), parts)) if n]


def probe_keys(word: str, edits: int, lengths: range | None = None) -> list[str]:
    """Substrings at which an indexed word within `edits` of word must agree in one segment."""
    out = set()
    for other in lengths or range(max(edits + 2, len(word) - edits), len(word) + edits + 1):
        delta = len(word) - other
        for i, (a, n) in enumerate(segments(other, 2 * edits + 1)):
            for s in range(-((edits - delta) // 2), (edits + delta) // 2 + 1):
                if n and 0 <= a + s and a + s + n <= len(word):
                    out.add(f"{edits}:{i}:{other}:{word[a + s:a + s + n]}")
    return sorted(out)


def index_words(word: str, edits: int) -> list[str]:
    """Segments of word: those for `edits` among short words, and those for one more where one of the two is long."""
    out = index_keys(word, edits) if len(word) < LONG else []
    return out + (index_keys(word, edits + 1) if len(word) >= LONG - edits - 1 else [])


def probe_words(word: str, edits: int, longer: bool = True) -> list[str]:
    """Keys of index_words that every word near enough to word has one of; without longer, only words not longer."""
    n, most = len(word), edits + 1
    out = []
    if n < LONG:
        out += probe_keys(word, edits, range(max(edits + 2, n - edits), min(LONG - 1, n + edits if longer else n) + 1))
    long_ = range(max(LONG - most, n - most) if n >= LONG else LONG, (n + most if longer else n) + 1)
    return out + (probe_keys(word, most, long_) if long_ else [])


_READ = "kind string, tags array<string>, core string, words array<string>, given array<string>, middle string, city string, region string, weak boolean"


def read_names(df: DataFrame, id_col: str, name: str, city: str, region: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(learned_reader(df.select(name)))  # bounded, see learned_reader

    def run(batches):
        reader = shared.value
        for pdf in batches:
            out = []
            for i, n, c, r in zip(pdf["id"], pdf["n"], pdf["c"], pdf["r"]):
                kind, words, given, middle = reader.read(n) or ("", [], [], "")
                text = "".join(words) or "".join(x for x in fold(n) if x.isalnum())  # a name in another script stands as it is
                if not text:
                    continue
                place, state = city_key(c), re.sub(r"[^A-Z]", "", (r or "").upper())
                weak = not place or kind == "" and len(words) < 2 or kind == "person" and (len(given) != 1 or len(given[0]) == 1)
                out.append((i, kind, reader.tags(kind, given), text, words, given, middle, place, "" if state == "UNKNOWN" else state, weak))
            yield pd.DataFrame(out, columns=["id", "kind", "tags", "core", "words", "given", "middle", "city", "region", "weak"])

    return df.where(F.col(name).isNotNull()).select(F.col(id_col).alias("id"), F.col(name).alias("n"), F.col(city).alias("c"), F.col(region).alias("r")).mapInPandas(run, "id long, " + _READ)


def same_kind(a: Column, b: Column) -> Column:
    """Trades are the same if one has all words of the other."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (a == b) | (a != "") & (b != "") & (a != "person") & (b != "person") & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def words_apart(a: Column, b: Column, least: int = 5) -> Column:
    """Whether two lists of words differ in a short word, which is then another word and no slip."""
    short = lambda x, y: F.exists(F.array_except(x, y), lambda w: F.length(w) < least)
    return ((F.size(a) > 1) | (F.size(b) > 1)) & short(a, b) & short(b, a)


def same_word(a: Column, b: Column, edits: int) -> Column:
    """Banded edit distance within edits, an exchange of two letters counting as one edit."""
    near = F.levenshtein(a, b, edits)
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, edits + 1) >= 0) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (near >= 0) | swap


@F.pandas_udf(BooleanType())
def _within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([x is None or osa(x, y, int(k)) <= k for x, y, k in zip(a, b, most)])


def near_word(a: Column, b: Column, edits: int, sure: Column) -> Column:
    """same_word within edits; within one more, of which each may be an exchange, where one is long and sure holds."""
    close, most = same_word(a, b, edits), edits + 1
    long_ = sure & (F.greatest(F.length(a), F.length(b)) >= LONG)
    # only what the levenshtein distances leave open is given to Python
    open_ = long_ & ~close & (F.levenshtein(a, b, most) < 0)
    may = close | long_ & (F.levenshtein(a, b, 2 * most) >= 0)
    return may & _within(F.when(open_, a), F.when(open_, b), F.lit(most))


def _candidates(index: DataFrame, probe: DataFrame, edits: int, blocks_a: Column, blocks_b: Column, longer: bool = True) -> DataFrame:
    """Pairs (a from index, b from probe) that share a block and a segment. Only hashed keys are shuffled.

    Without longer, a is never the longer word: enough where both sides are the same table."""
    def keyed(df: DataFrame, make, blocks: Column, out: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "blocks": pdf["blocks"], "segs": [make(w) for w in pdf["core"]]})

        flat = df.select("id", "core", blocks.alias("blocks")).mapInPandas(run, "id long, blocks array<string>, segs array<string>")
        return flat.select(F.col("id").alias(out), "segs", F.explode("blocks").alias("block")).select(out, "block", F.explode("segs").alias("seg")).select(out, F.xxhash64("block", "seg").alias("key"))

    a, b = keyed(index, lambda w: index_words(w, edits), blocks_a, "a"), keyed(probe, lambda w: probe_words(w, edits, longer), blocks_b, "b")
    return a.join(b.hint("merge"), "key").where("a <> b").select("a", "b").distinct()


def link_names(df: DataFrame, id_col: str, name: str = "business_name", city: str = "city", region: str = "region", edits: int = 1) -> DataFrame:
    """(id, entity): entity is the smallest id of the mentions of the same person or organisation.

    Two spellings are at most edits apart, one more where one of them has LONG letters."""
    read = staged(read_names(df, id_col, name, city, region), "names")
    cols = ["kind", "tags", "core", "words", "given", "middle", "city", "region", "weak"]
    # identical readings are one representative; copies never meet in a pair
    counts = read.groupBy(*cols).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    support = counts.groupBy("kind", "core").agg(F.sum("n").alias("support"))
    reps = staged(counts.drop("n").join(support.hint("merge"), ["kind", "core"]), "name-reps")
    strong, weak = reps.where("not weak"), reps.where("weak")

    # a city typed with one slip keeps its first or its last letters
    ends = lambda x: F.array(F.concat_ws("|", x, F.lit("<"), F.substring("city", 1, 4)), F.concat_ws("|", x, F.lit(">"), F.substring("city", -4, 4)))
    blocks = F.flatten(F.transform("tags", ends))
    pairs = _candidates(strong, strong, edits, blocks, blocks, longer=False)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in [*cols, "support"]]).hint("merge")

    agree = ((F.col("a_region") == "") | (F.col("b_region") == "") | (F.col("a_region") == F.col("b_region"))) & ((F.col("a_middle") == "") | (F.col("b_middle") == "") | (F.col("a_middle") == F.col("b_middle")))
    town = (F.col("a_city") == "") | (F.col("b_city") == "") | (F.levenshtein("a_city", "b_city", 2) >= 0)
    given = (F.col("a_kind") != "person") | F.arrays_overlap("a_given", "b_given")
    initial = F.exists("a_given", lambda g: F.exists("b_given", lambda h: F.when((F.length(g) == 1) | (F.length(h) == 1), F.substring(g, 1, 1) == F.substring(h, 1, 1)).otherwise(g == h)))
    # two spellings that both occur often are two names: a slip is rarely made twice
    rare = F.least("a_support", "b_support") <= F.greatest(F.lit(2), F.greatest("a_support", "b_support") / 3)
    # a second edit needs a place without doubt: two towns may be two edits apart
    sure = (F.col("a_city") != "") & (F.col("b_city") != "") & same_word(F.col("a_city"), F.col("b_city"), 1) | (F.col("a_region") != "") & (F.col("a_region") == F.col("b_region"))
    core = (F.col("a_core") == F.col("b_core")) | rare & (F.least(F.length("a_core"), F.length("b_core")) >= 3) & ~words_apart(F.col("a_words"), F.col("b_words")) & near_word(F.col("a_core"), F.col("b_core"), edits, sure)
    kind = same_kind(F.col("a_kind"), F.col("b_kind"))

    edges = pairs.join(side(strong, "a"), "a").join(side(strong, "b"), "b").where(kind & agree & town & given & core).select("a", "b")
    entity = staged(strong.select("id").join(components(edges).hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("entity")), "name-groups")

    # names that say too little join the one entity they fit; a name without a kind may fit any
    weak_tags = (F.when(F.col("kind") == "person", F.array_distinct(F.transform("given", lambda g: F.concat(F.lit("person|"), F.substring(g, 1, 1)))))
                 .when(F.col("kind") == "", F.array(F.lit("any"))).otherwise(F.col("tags")))
    near_strong, near_weak = (F.flatten(F.transform(x, ends)) for x in (F.concat("tags", F.array(F.lit("any"))), weak_tags))
    nearby = _candidates(strong, weak.where("city <> ''"), edits, near_strong, near_weak)
    placeless = weak.where("city = ''").select(F.col("id").alias("b"), F.explode(F.array("core")).alias("core"))
    anywhere = strong.select(F.col("id").alias("a"), "core").join(placeless.hint("merge"), "core").select("a", "b")
    in_region = F.transform("tags", lambda x: F.concat_ws("|", F.when(F.col("kind") == "person", "person").otherwise(x), "region"))
    slipped = _candidates(strong, weak.where("city = ''"), edits, in_region, in_region).select("a", "b")
    fit = (nearby.unionByName(anywhere).unionByName(slipped).distinct().join(side(strong, "a"), "a").join(side(weak, "b"), "b")
           .where(((F.col("b_kind") == "") | kind) & agree & town & core & ((F.col("a_kind") != "person") | (F.col("b_kind") == "") | initial)))
    fit = staged(fit.select("b", "a", F.when(F.col("a_core") == F.col("b_core"), 0).when(same_word(F.col("a_core"), F.col("b_core"), edits), 1).otherwise(2).alias("d")), "name-fits")
    fit = fit.join(entity.withColumnRenamed("id", "a").hint("merge"), "a")
    # a name whose nearest fits belong to several entities joins none
    nearest = fit.groupBy("b", "d").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).groupBy("b").agg(F.min_by(F.struct("entity", "other"), "d").alias("x"))
    chosen = nearest.where("x.entity = x.other").select(F.col("b").alias("id"), F.col("x.entity").alias("entity"))
    joined = weak.select("id").join(chosen.hint("merge"), "id", "left").select("id", F.coalesce("entity", "id").alias("entity"))
    members = staged(reps.join(entity.unionByName(joined).hint("merge"), "id").select(*cols, "entity"), "name-members")
    on = None
    left, right = read.alias("l"), members.hint("merge").alias("r")
    for c in cols:
        on = (F.col(f"l.{c}") == F.col(f"r.{c}")) if on is None else on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return left.join(right, on).select(F.col("l.id").alias("id"), F.col("r.entity").alias("entity"))


def p6_entities(mentions: DataFrame) -> DataFrame:
    """One row per mention with a readable name: mention_id, entity_id."""
    return link_names(mentions, "mention_id").select(F.col("id").alias("mention_id"), F.col("entity").alias("entity_id"))


def p6_found(mentions: DataFrame) -> DataFrame:
    e = staged(link_names(mentions, "mention_id"), "entities")
    return (e.select(F.col("id").alias("mention_id_a"), "entity").join(e.select(F.col("id").alias("mention_id_b"), "entity").hint("merge"), "entity")
            .where("mention_id_a < mention_id_b").select("mention_id_a", "mention_id_b"))
