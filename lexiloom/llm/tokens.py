"""Tokenizer files: byte-level BPE ids, and unigram token counts over a trie of pre-tokens."""

from __future__ import annotations

import json
import math
from collections import Counter, deque
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_texts

#: The trie holds at most NODES nodes and the cache WORDS words of at most LONG bytes, whatever comes.
PIECES, NODES, WORDS, LONG = "piece_bpe_32k.model", 400_000, 400_000, 1_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class BpeEncoder:
    """Text to the ids that ``tokenizers`` gives for a byte-level BPE file with add_special_tokens=False.

    If the file's ids follow the order of its merges, as in the public 50k file, the merges
    are run by tiktoken, which is several times faster with the same ids. A text that holds
    the content of a special or added token, and any other file, goes to tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, special = spec["model"]["vocab"], [t["content"] for t in spec.get("added_tokens", [])]
        tok = Tokenizer.from_file(path)
        self._exact: Callable[[str], np.ndarray] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
        self._fast, self._special = None, special
        letters = _byte_alphabet()
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        order = [vocab[m] for m in merged]
        if spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and order == sorted(order):
            import public_tokenizers
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            core = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self._fast = lambda text: np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return self._exact(text) if self._fast is None or any(t in text for t in self._special) else self._fast(text)

    def __call__(self, text: str, end: int | None = None) -> np.ndarray:
        ids = self._ids(text)
        return ids if end is None else np.append(ids, np.uint32(end))

    @staticmethod
    @lru_cache(2)
    def load(path: str | None = None) -> BpeEncoder:
        return BpeEncoder(path or public_path("byte_bpe_50k.json"))


def zipf_pieces(path: str | None = None) -> dict[str, float]:
    """Pieces of a sentencepiece file with unigram scores: the logarithm of 1 / (rank + 1), normalised.

    The files at hand rank their pieces and hold no probabilities; Zipf's law stands in.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_path(PIECES))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class UnigramTrie:
    """Token counts of pre-tokens under the best unigram segmentation.

    Pre-tokens share a trie. A node holds the best score of any segmentation of its prefix
    and that segmentation's length, worked out once when the node is made, from the nodes
    above it; a pre-token's count is read at its last node. A character without a piece
    scores ``unknown`` and counts as its UTF-8 bytes. Equal scores: the shorter
    segmentation. The trie starts anew at ``nodes`` nodes. A pre-token of over ``long``
    characters is worked out alone, by the same steps over a window of the longest piece's
    length, and leaves no nodes.
    """

    def __init__(self, pieces: dict[str, float], nodes: int = NODES, long: int = LONG):
        self.pieces, self.nodes, self.long = pieces, nodes, min(long, nodes - 1)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces of two or more characters that end with two given ones.
        self.lengths = {end: tuple(sorted(n)) for end, n in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def _alone(self, ch: str) -> tuple[float, int]:
        """Score and tokens of a character by itself."""
        score = self.pieces.get(ch)
        return (self.unknown, len(ch.encode("utf-8", "surrogatepass"))) if score is None else (score, 1)

    def _long(self, word: str) -> int:
        best, count = deque([0.0], self.longest), deque([0], self.longest)  # of the prefixes before, the longest one first
        for i, ch in enumerate(word, 1):
            score, n = self._alone(ch)
            score, n = best[0] + score, count[0] + n
            for k in self.lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                if k > i:
                    break
                own = self.pieces.get(word[i - k : i])
                if own is not None and (own + best[k - 1] > score or own + best[k - 1] == score and count[k - 1] + 1 < n):
                    score, n = own + best[k - 1], count[k - 1] + 1
            best.appendleft(score), count.appendleft(n)
        return count[0]

    def __call__(self, word: str) -> int:
        if len(word) > self.long:
            return self._long(word)
        if len(self.best) + len(word) > self.nodes:
            self.clear()
        child, best, count, get = self.child, self.best, self.count, self.pieces.get
        node, path = 0, [0]
        for i, ch in enumerate(word, 1):
            key = node << 21 | ord(ch)
            above, node = node, child.get(key, -1)
            if node < 0:
                top, n = self._alone(ch)
                top, n = best[above] + top, count[above] + n
                for k in self.lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                    if k > i:
                        break
                    score = get(word[i - k : i])
                    if score is not None:
                        above = path[i - k]
                        score += best[above]
                        if score > top or score == top and count[above] + 1 < n:
                            top, n = score, count[above] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(n)
            path.append(node)
        return count[node]


_tries: dict[str | None, tuple[UnigramTrie, dict[bytes, int]]] = {}


def unigram_counts(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_distinct_words, n_tokens.

    Pre-tokens are the runs of characters other than ASCII white space, each after the mark
    of a word's start. Distinct pre-tokens meet in the trie of a worker, which lives on from
    task to task: joining them across the corpus instead would shuffle every word of every
    document. A null or empty text has zeros; repeated rows count alike; an empty table
    gives an empty result; other columns are ignored.
    """

    def work():
        if pieces not in _tries:  # a worker's next tasks go on with the trie
            _tries[pieces] = UnigramTrie(zipf_pieces(pieces)), {}
        trie, known = _tries[pieces]

        def row(text: str | None) -> tuple[int, int, int]:
            seen = Counter((text or "").encode("utf-8", "surrogatepass").split())
            total = 0
            for w, times in seen.items():
                c = known.get(w)
                if c is None:
                    c = trie("▁" + w.decode("utf-8", "surrogatepass"))
                    if len(w) <= LONG:
                        if len(known) >= WORDS:
                            known.clear()
                        known[w] = c
                total += c * times
            return seen.total(), len(seen), total

        return row

    made = dict.fromkeys(["n_words", "n_distinct_words", "n_tokens"], pa.int64())
    return from_texts(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], made, work)
