"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A
text is cross-parsed against it: from each place the longest match within the sample is a
phrase, and the next phrase starts after it. The language needing fewest phrases, by the
bits they would take a character, wins. Many texts are walked through an automaton in
step, each from its first letter to its last.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import training_rows

#: Characters of training text a language.
SAMPLE_CHARS = 40_000
#: An automaton of more table entries than this keeps its steps sorted instead of in a table.
DENSE = 16_000_000
#: Fewer texts than this aren't walked in step but one by one.
LANES = 24
#: Texts are walked together up to so many, and up to so many characters.
TOGETHER, TOGETHER_CHARS = 4_096, 4_000_000
#: Scores: a language that takes one bit a character more weighs 2 to this power less.
SHARPNESS = 8
_AGAIN = np.int64(1 << 40)


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def fold(text: str) -> np.ndarray:
    """Code points in lower case, with every run of characters other than letters as one space, none at either end."""
    c = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    c = c[keep]
    if len(c) and c[0] == 32:
        c = c[1:]
    return c[:-1] if len(c) and c[-1] == 32 else c


class SuffixAutomaton:
    """All substrings of a sequence of symbols below ``symbols``: the next states of each state by symbol, and each state's longest string."""

    def __init__(self, data: list[int], symbols: int):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in data:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.symbols = nxt, symbols


class Parser:
    """Steps of an automaton, in which one from the root, or one that is missing, begins a phrase there and is marked by the bit _AGAIN.

    A symbol that the sample lacks is a phrase of its own and leads back to the root.
    """

    def __init__(self, automaton: SuffixAutomaton, dense: int = DENSE):
        nxt, self.symbols = automaton.next, automaton.symbols + 1
        self.again = np.full(self.symbols, _AGAIN)
        for c, t in nxt[0].items():
            self.again[c] |= t
        edges = [(s * self.symbols + c, t) for s, e in enumerate(nxt) if s for c, t in e.items()]
        keys, to = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int64)
        self.table = None
        if len(nxt) * self.symbols <= dense:
            self.table = np.tile(self.again, len(nxt))
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; the last symbol stands for all that the sample lacks."""
        key = state * self.symbols + symbol
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.again[symbol])


class LanguageModel:
    """A parser for each language over the letters of its own sample."""

    def __init__(self, samples: dict[str, np.ndarray], dense: int = DENSE):
        self.languages = sorted(samples)
        self.points = np.unique(np.concatenate([samples[g] for g in self.languages]))
        self.own, self.parsers = [], []
        for g in self.languages:
            mine = np.unique(samples[g])
            # of each known letter its number in this language; other letters have the last one
            own = np.full(len(self.points) + 1, len(mine), np.int64)
            own[np.searchsorted(self.points, mine)] = np.arange(len(mine))
            self.own.append(own)
            self.parsers.append(Parser(SuffixAutomaton(np.searchsorted(mine, samples[g]).tolist(), len(mine)), dense))
        self.bits = [math.log2(max(2, len(samples[g]))) for g in self.languages]

    def _codes(self, text: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, text)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == text, at, len(self.points))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text, a column for each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
        while order:
            n = min(len(order), TOGETHER, max(1, TOGETHER_CHARS // len(texts[order[0]])))
            now, order = order[:n], order[n:]
            codes = [self._codes(texts[i]) for i in now]
            for g in range(len(self.languages)):
                out[now, g] = self._walk(g, codes)
        return out

    def _walk(self, g: int, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of texts in the order of falling length: those still going are walked in step, and the last few alone."""
        own, parser = self.own[g], self.parsers[g]
        sizes = np.array([len(c) for c in codes])
        steps = int(sizes[LANES]) if len(codes) > LANES else 0
        grid = np.zeros((steps, len(codes)), np.int64)
        for lane, c in enumerate(codes):
            grid[: min(steps, len(c)), lane] = own[c[:steps]]
        alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right").tolist()
        state, count = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for k, n in enumerate(alive):
            to = parser.step(state[:n], grid[k, :n])
            count[:n] += to >> 40
            state[:n] = to & (_AGAIN - 1)
        for lane in range(int((sizes > steps).sum())):
            count[lane] += self._alone(parser, own[codes[lane][steps:]], int(state[lane]))
        return count

    @staticmethod
    def _alone(parser: Parser, symbols: np.ndarray, state: int) -> int:
        count, again = 0, int(_AGAIN)
        if parser.table is not None:
            table, width = parser.table, parser.symbols
            for c in symbols.tolist():
                state = int(table[state * width + c])
                if state >= again:
                    state -= again
                    count += 1
            return count
        for c in symbols:
            to = int(parser.step(np.array([state]), np.array([c]))[0])
            state, count = to & (again - 1), count + (to >> 40)
        return count


def train(docs: DataFrame, chars: int = SAMPLE_CHARS) -> LanguageModel | None:
    """Learn from ``chars`` characters a language: whole texts with a letter in the order of their hashed ids, of the last only a piece from a hashed place.

    Rows of one id and language count as one. Every text has a character at least, so the
    first ``chars`` ids of a language always suffice.
    """
    ok = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & training_rows() & F.col("text").rlike("\\p{L}"))
    ids = ok.groupBy("lang", "doc_id").agg(F.max(F.length("text")).alias("size")).withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    first = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= chars)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    chosen = first.withColumn("before", before).where(F.col("before") < chars).select("lang", "doc_id", "r", (chars - F.col("before")).alias("wanted"))
    # at most ``chars`` rows of four values a language, in practice a few dozen
    piece = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - F.col("wanted"), F.lit(0)) + 1).cast("int") + 1, F.col("wanted").cast("int"))
    taken = ok.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "r", piece.alias("piece")).groupBy("lang", "r").agg(F.min("piece").alias("piece"))
    texts: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["r"])):
        texts.setdefault(r["lang"], []).append(r["piece"])
    samples = {g: t for g, x in texts.items() if len(t := fold(" ".join(x)))}
    return LanguageModel(samples) if samples else None


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, and bits a character for the winner.

    lang_pred is ``und``, with score 0, if the text is null or has no letter, or nothing
    could be learnt. Ties go to the language first in the alphabet. The score is the share
    of the winner among all languages, each weighing 2 to the power of minus SHARPNESS times its bits.
    Repeated rows are judged alike; a null id isn't held out; empty tables are fine.
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", "bits"]

    def judged(m: LanguageModel | None, texts: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
        pred, score, bits = [], [], []
        counts = m.phrases(texts) if m else None
        for i, t in enumerate(texts):
            if not len(t) or m is None:
                pred.append("und"), score.append(0.0), bits.append(None)
                continue
            cost = counts[i] * np.array(m.bits) / len(t)
            k = int(cost.argmin())
            weight = 2.0 ** (SHARPNESS * (cost.min() - cost))
            pred.append(m.languages[k]), score.append(float(1 / weight.sum())), bits.append(float(cost[k]))
        return pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())

    def run(batches):
        m = sent.value
        for b in batches:
            made = judged(m, [fold(t.as_py() or "") for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *made], names=names)

    asked = docs.select(F.col("doc_id").cast("long"), F.coalesce(~training_rows(), F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double")
