"""Text garbled by decoding with a wrong encoding: found by expectation-maximization, and restored.

Model. Every word with characters outside ASCII was written clean, drawn from a character
model of the corpus, and then went through a latent encoding chain: none, one wrong
decoding (bytes of `right` read as `wrong`), the same twice, or one that lost characters
(U+FFFD). A chain is undone by the inverse mapping, so the likelihood of a word under a
chain is that of its inverse under the character model.

Evidence of all words of a record adds up per chain, and each source and field has its own
prior of chains, drawn towards that of the corpus, so weak evidence pools across records.
E step: posterior of each chain for each record. M step: character counts of the words,
weighted by their probability of being clean, and the chain counts per source. The first
E step uses a fixed model of which kinds of characters follow one another. The posterior
then repairs each word of a record.

What every task holds of the corpus is the character model: counts hashed into TRIGRAMS +
BIGRAMS + SINGLES places, whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import join_sized, materialize, tidy_key

TRIGRAMS, BIGRAMS, SINGLES = 1 << 20, 1 << 18, 1 << 16

#: Encodings that text is wrongly read as, those it was written in, and those of several bytes a character.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-2")
RIGHT = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "mac_cyrillic")
MULTIBYTE = ("cp932", "euc_jp", "gb18030", "euc_kr")

NONE, LOST = 0, 1
#: The chains: (right, wrong, times); the first two are no chain at all and lost characters.
CHAINS: tuple[tuple[str, str, int], ...] = (
    ("", "", 0), ("", "lost", 0),
    *(("utf-8", w, 1) for w in WRONG), *(("utf-8", w, 2) for w in WRONG[:7]),
    *((m, w, 1) for m in MULTIBYTE for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")),
    *((r, w, 1) for r in RIGHT for w in WRONG if r != w),
)
#: Priors before any data: of no chain, and of each chain (multi-byte encodings are the commoner mistake).
PRIOR_NONE = 0.97

#: Words end at blanks, and at the border between East Asian and other writing.
_EAST = "\u3000-\u9fff\uac00-\ud7af\uff00-\uffef"
_WORD = re.compile(rf"[{_EAST}]+|[^ \t\r\n\f\v{_EAST}]*[^\x00-\x7f{_EAST}][^ \t\r\n\f\v{_EAST}]*")
_DIGITS = re.compile(r"[0-9]+")


def chain_name(k: int) -> str:
    right, wrong, times = CHAINS[k]
    return "none" if k == NONE else "lost characters" if k == LOST else f"{right} read as {wrong}" + " twice" * (times == 2)


def first_prior() -> np.ndarray:
    p = np.array([4.0 if r == "utf-8" or w == "lost" else 1.0 for r, w, _ in CHAINS])
    p[NONE] = 0
    p *= (1 - PRIOR_NONE) / p.sum()
    p[NONE] = PRIOR_NONE
    return p


# ---- chains ------------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def _to_bytes(wrong: str) -> dict[int, int]:
    """Code point -> byte of the wrong encoding, as str.translate takes it; U+0100 where there is none.

    Bytes that the encoding leaves undefined stand as the control character of the same number.
    """
    out = {c: 0x100 for c in range(0xA0, 0x100)}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(wrong))] = b
        except UnicodeDecodeError:
            pass
    return out


def undo(word: str, k: int) -> str | None:
    """The word before chain k, None where the chain cannot have made it or changes nothing."""
    right, wrong, times = CHAINS[k]
    if k == LOST:
        return word if "�" in word else None
    out = word
    for _ in range(times):
        try:
            out = out.translate(_to_bytes(wrong)).encode("latin-1").decode(right)
        except UnicodeError:
            return None
    return out if out != word else None


#: The chains by what the text was wrongly read as and how often.
_BY_WRONG: dict[tuple[str, int], list[tuple[int, str]]] = {}
for _k, (_right, _wrong, _times) in enumerate(CHAINS):
    if _k > LOST:
        _BY_WRONG.setdefault((_wrong, _times), []).append((_k, _right))


def undo_all(word: str) -> list[tuple[int, str]]:
    """(chain, word before it) of all chains that undo() takes back, in the order of the chains."""
    out = []
    for (wrong, times), chains in _BY_WRONG.items():
        if times > 1:
            out += [(k, back) for k, _ in chains if (back := undo(word, k)) is not None]
            continue
        try:
            raw = word.translate(_to_bytes(wrong)).encode("latin-1")
        except UnicodeError:
            continue
        for k, right in chains:
            try:
                back = raw.decode(right)
            except UnicodeError:
                continue
            if back != word:
                out.append((k, back))
    return sorted(out)


# ---- character model ----------------------------------------------------------------------

@functools.lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """A ASCII letter, D digit, P ASCII sign, L other Latin, Y Cyrillic, G Greek, J kana and East Asian signs, H Han and other East Asian, T typographic sign, S symbol, B box, M mark or format, C control, X replacement, O other."""
    o = ord(c)
    if o < 0x80:
        return "A" if c.isalpha() else "D" if c.isdigit() else "P"
    if o < 0xA0 or c in "\xa0\xad":
        return "C"
    if c == "�":
        return "X"
    if 0x2500 <= o < 0x25A0:
        return "B"
    if 0x400 <= o < 0x530:
        return "Y" if 0x410 <= o < 0x450 or c in "Ёё" else "y"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x3000 <= o < 0x3100:
        return "J"
    if 0x3100 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xFF00 <= o < 0xFFF0:
        return "H"
    cat = unicodedata.category(c)
    if cat in ("Mn", "Me", "Cf"):
        return "M"
    if c.isalpha() and o < 0x250 and c not in "ªº":
        return "L"
    if c in "‘’“”–—…¿¡«»„":
        return "T"
    if cat[0] in "SN" or c in "·µ§ªº¶":
        return "S"
    return "O"


_COST = {"A": 3.2, "D": 1.5, "P": 3.0, "L": 5.5, "Y": 3.4, "y": 7.5, "G": 6.5, "J": 4.8, "H": 8.0, "T": 4.5, "S": 5.5, "B": 5.5, "M": 6.0, "C": 11.0, "X": 11.0, "O": 9.0, "^": 1.0}
_LETTERS = "ALYyG"


@functools.lru_cache(maxsize=1 << 18)
def base_cost(b: str, c: str) -> float:
    """Cost in nats of c after b before any counts: by kinds of characters, scripts and case."""
    p, q = _kind(b) if b != "^" else "^", _kind(c) if c != "^" else "^"
    cost = _COST[q]
    if p == "^" or q == "^":
        return cost
    if p in _LETTERS and q in _LETTERS:
        latin = "AL"
        if (p in latin) != (q in latin) or (p == "G") != (q == "G"):
            cost += 5.0
        if p == "L" and q == "L":
            cost += 2.0
        if b.islower() and c.isupper():
            cost += 3.0
    elif p in _LETTERS and q in "SB":
        cost += 3.0
    elif p in "SB" and q in _LETTERS:
        cost += 2.0
    elif p in _LETTERS and q == "T" and c in "¿¡“‘„":
        cost += 2.5
    elif p in "JH" and q in _LETTERS or q in "JH" and p in _LETTERS:
        cost += 4.0
    return cost


#: Code points of the border of a word and of a lost character.
BORDER, LOST_CHAR = ord("^"), 0xFFFD


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every character of the words and of the border behind each: its code point, those of the two before it, and where the words begin."""
    c = np.frombuffer("".join(w + "^" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    size = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    first = np.cumsum(size) - size
    b = np.r_[BORDER, c[:-1]]
    b[first] = BORDER
    a = np.r_[BORDER, b[:-1]]
    a[first] = BORDER
    return c, b, a, first


def _h3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D + (a ^ c) * 0x27D4EB2F >> 7) & (TRIGRAMS - 1)


def _h2(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b * 0x9E3779B1 + c * 0x85EBCA77 >> 9) & (BIGRAMS - 1)


@dataclass
class CharModel:
    """Hashed counts of single characters, pairs and triples; empty: the fixed costs only."""

    three: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    two: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    one: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))

    def costs(self, words: list[str]) -> np.ndarray:
        """-log probability of each word; a replacement character costs what it did at first."""
        if not words:
            return np.empty(0)
        c, b, a, first = _codes(words)
        pair, at = np.unique(b << 21 | c, return_inverse=True)
        out = np.array([base_cost(chr(k >> 21), chr(k & 0x1FFFFF)) for k in pair.tolist()])[at]
        if len(self.one):
            p = (self.two[_h2(b, c)] + 4.0 * np.exp(-out)) / (self.one[b & (SINGLES - 1)] + 4.0)
            p = (self.three[_h3(a, b, c)] + 2.0 * p) / (self.two[_h2(a, b)] + 2.0)
            out = np.where((b == LOST_CHAR) | (c == LOST_CHAR), out, -np.log(np.minimum(1.0, p)))
        return np.add.reduceat(out, first)


# ---- inference ------------------------------------------------------------------------------

#: A word counts for a chain from this gain on, and for at most so much: no word decides alone.
GAIN_LEAST, GAIN_MOST = 1.5, 14.0
#: While nothing is learned yet, from this one on.
GAIN_FIRST = 5.0


class Reader:
    """Gains of words under the chains, kept for the words of a task."""

    def __init__(self, model: CharModel):
        self.model = model
        self.least = GAIN_LEAST if len(model.one) else GAIN_FIRST
        self.known: dict[str, list[tuple[int, float]]] = {}

    def prepare(self, words, block: int = 4096) -> None:
        """Learn the gains of words: all that their inverses cost, once each and at once."""
        if len(self.known) > 400_000:
            self.known.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        for s in range(0, len(new), block):
            part, texts, place = new[s:s + block], [], {}
            backs = []
            for w in part:
                found = undo_all(w)
                backs.append(found)
                for t in (w, *(back for _, back in found)):
                    if t not in place:
                        place[t] = len(texts)
                        texts.append(t)
            cost = np.round(self.model.costs(texts), 9).tolist()
            for w, found in zip(part, backs):
                own = cost[place[w]]
                gains = [(k, round(own - cost[place[back]], 9)) for k, back in found]
                if (lost := w.count("\ufffd")) and 6.0 * lost >= self.least:
                    gains.insert(0, (LOST, 6.0 * lost))
                self.known[w] = [(k, min(g, GAIN_MOST)) for k, g in gains if g >= self.least]

    def gains(self, word: str) -> list[tuple[int, float]]:
        """(chain, gain in nats) of every chain whose inverse of the word is likelier than the word."""
        if word not in self.known:
            self.prepare([word])
        return self.known[word]

    def posterior(self, words: list[str], prior: np.ndarray) -> tuple[dict[int, float], dict[str, float], float]:
        """Of a record: probability of each chain that any word speaks for, of each garbled word, and the best log odds.

        Chains are weighed one by one against none: a record may hold passages of several.
        """
        total: dict[int, float] = {}
        by_word = {}
        for w in words:
            by_word[w] = g = self.gains(w)
            for k, gain in g:
                total[k] = total.get(k, 0.0) + gain
        if not total:
            return {}, {}, -99.0
        odds = {k: t + log(prior[k] / prior[NONE]) for k, t in total.items()}
        prob = {k: 1 / (1 + exp(-max(-50.0, min(50.0, o)))) for k, o in odds.items()}
        # chains that explain the same words share them
        garbled: dict[str, float] = {}
        share: dict[int, float] = {}
        for w, g in by_word.items():
            live = [(k, gain, prob[k]) for k, gain in g]
            if not live:
                continue
            garbled[w] = max(p for _, _, p in live)
            top = max(odds[k] for k, _, _ in live)
            weight = [exp(min(0.0, odds[k] - top)) * p for k, _, p in live]
            s = sum(weight)
            for (k, _, _), x in zip(live, weight):
                share[k] = max(share.get(k, 0.0), x / s * garbled[w] if s else 0.0)
        return share, garbled, max(odds.values())


def words_of(text: str) -> list[str]:
    """The distinct words of a text with characters outside ASCII, runs of digits as one 0."""
    return list(dict.fromkeys(_DIGITS.sub("0", w) for w in _WORD.findall(text)))


def repair(text: str, reader: Reader, prior: np.ndarray, level: float = 0.5) -> tuple[str, Counter, int, int]:
    """The text with its garbled words restored; the chains undone, with their words; garbled words; those not restorable.

    What a restored text still holds of garbled words (wrongly decoded more than once) is restored in turn.
    """
    used: Counter = Counter()
    garbled = lost = 0
    for turn in range(3):
        reader.prepare(words_of(text))
        total: dict[int, float] = {}
        for w in words_of(text):
            for k, gain in reader.gains(w):
                total[k] = total.get(k, 0.0) + gain
        odds = {k: t + log(prior[k] / prior[NONE]) for k, t in total.items()}
        changed = False
        parts, end = [], 0
        for m in _WORD.finditer(text):
            live = [(odds[k], k) for k, _ in reader.gains(_DIGITS.sub("0", m.group())) if odds[k] > log(level / (1 - level))]
            if not live:
                continue
            k = max(live)[1]
            back = None if k == LOST else undo(m.group(), k)
            if turn == 0:
                garbled += 1
                lost += back is None
            if back is not None:
                used[k] += 1
                changed = True
                parts += [text[end:m.start()], back]
                end = m.end()
            elif turn == 0:
                used[k] += 1
        if not changed:
            break
        text = "".join(parts) + text[end:]
    return text, used, garbled, lost


# ---- plan -----------------------------------------------------------------------------------

def _learn(rows: DataFrame, model: CharModel, prior: np.ndarray) -> tuple[CharModel, np.ndarray, DataFrame]:
    """One E and M step: the next character model, corpus prior, and (key, prior) per source."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, priors = Reader(model), Priors(prior)
        sums = [np.zeros(n, dtype=np.float64) for n in (TRIGRAMS, BIGRAMS, SINGLES)]
        chains: dict[str, np.ndarray] = {}
        clean: dict[str, float] = {}
        for pdf in batches:
            reader.prepare(w for words in pdf["words"] for w in words)
            for key, words, own in zip(pdf["key"], pdf["words"], pdf["prior"]):
                words = list(words)
                p = priors.of(key, own)
                share, garbled, _ = reader.posterior(words, p)
                for w in words:
                    clean[w] = clean.get(w, 0.0) + 1.0 - garbled.get(w, 0.0)
                n = chains.setdefault(key, np.zeros(len(CHAINS)))
                for k, x in share.items():
                    n[k] += x
                n[NONE] += max(0.0, 1.0 - max(share.values(), default=0.0))
            if len(clean) > 100_000:
                _add(sums, clean)
        _add(sums, clean)
        for part, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"key": None, "part": part, "place": at, "n": s[at]})
        for key, n in chains.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"key": key, "part": 3, "place": at, "n": n[at]})

    counted = materialize(rows.mapInPandas(count, "key string, part int, place int, n double").groupBy("key", "part", "place").agg(F.sum("n").alias("n")), "counted")
    arrays = [np.zeros(n, dtype=np.float32) for n in (TRIGRAMS, BIGRAMS, SINGLES)]
    got = counted.where("part < 3").select("part", "place", "n").toPandas()
    for part, a in enumerate(arrays):
        mine = got[got["part"] == part]
        a[mine["place"].to_numpy()] = mine["n"].to_numpy()
    by_chain = counted.where("part = 3")
    total = np.full(len(CHAINS), 0.02)
    for r in by_chain.groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r["place"]] += r["n"]
    corpus = total / total.sum()
    # at most one entry per chain and source, and few sources have many
    each = by_chain.groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("prior"))
    return CharModel(*arrays), corpus, materialize(each, "priors")


#: Records that the corpus prior counts for beside a source's own.
PULL = 20.0


class Priors:
    """The prior of each source: its own chain counts drawn towards the corpus; kept for the sources of a task."""

    def __init__(self, corpus: np.ndarray):
        self.corpus, self.known = corpus, {}

    def of(self, key: str, counts) -> np.ndarray:
        if counts is None:
            return self.corpus
        found = self.known.get(key)
        if found is None:
            n = np.zeros(len(CHAINS))
            for r in counts:
                n[r["place"]] = r["n"]
            found = (n + PULL * self.corpus) / (n.sum() + PULL)
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = found
        return found


def _add(sums: list[np.ndarray], clean: dict[str, float], block: int = 20_000) -> None:
    """Count the characters, pairs and triples of words, each word as often as it says, and empty the words."""
    kept = [(w, n) for w, n in clean.items() if n > 0]
    for s in range(0, len(kept), block):
        words, n = [w for w, _ in kept[s:s + block]], np.array([n for _, n in kept[s:s + block]])
        c, b, a, first = _codes(words)
        weight = np.repeat(n, np.diff(np.r_[first, len(c)]))
        for total, at in zip(sums, (_h3(a, b, c), _h2(b, c), c & (SINGLES - 1))):
            total += np.bincount(at, weight, len(total))
        border = np.array([BORDER])
        sums[1][_h2(border, border)] += n.sum()
        sums[2][BORDER] += n.sum()
    clean.clear()


def garbled_texts(df: DataFrame, id: str, text: str, source: str | None, rounds: int = 3, level: float = 0.5, with_text: bool = True) -> DataFrame:
    """(id, garbled_words, lost_words, chains, log_odds, restored) of every record with a garbled passage.

    chains names what was undone, the commonest first; lost_words counts words whose
    characters are gone; restored is the whole text with everything restorable put right
    (null with with_text=False). Null, empty and pure ASCII texts are never garbled. A null
    source is a source of its own. Rows come out as often as they come in; other columns are
    not read. Empty tables give no rows.
    """
    key = F.coalesce(tidy_key(F.col(source)), F.lit("")) if source else F.lit("")
    key = F.concat(key, F.lit("/"), F.lit(text))
    base = df.select(F.col(id).alias("id"), key.alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "words": pdf["text"].map(words_of)})

    words = materialize(base.mapInPandas(split, "key string, words array<string>", ), "words")
    model, prior, own = CharModel(), first_prior(), None
    for _ in range(rounds):
        rows = words.withColumn("prior", F.lit(None).cast("array<struct<place:int,n:double>>")) if own is None else join_sized(words, own, ["key"], "left")
        model, prior, own = _learn(rows, model, prior)
    rows = join_sized(base, own, ["key"], "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, priors = Reader(model), Priors(prior)
        for pdf in batches:
            out, found = [], pdf["text"].map(words_of)
            reader.prepare(w for words in found for w in words)
            for ident, key, t, mine, words in zip(pdf["id"], pdf["key"], pdf["text"], pdf["prior"], found):
                p = priors.of(key, mine)
                _, _, odds = reader.posterior(words, p)
                if odds <= log(level / (1 - level)):
                    continue
                back, used, garbled, lost = repair(t, reader, p, level)
                out.append((ident, garbled, lost, [chain_name(k) for k, _ in used.most_common()], odds, back if with_text else None))
            yield pd.DataFrame(out, columns=["id", "garbled_words", "lost_words", "chains", "log_odds", "restored"])

    schema = f"id {df.schema[id].dataType.simpleString()}, garbled_words bigint, lost_words bigint, chains array<string>, log_odds double, restored string"
    return rows.mapInPandas(judge, schema).withColumnRenamed("id", id)
