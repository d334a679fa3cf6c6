"""Operator 7, BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its parts fit; all leaves are encoded in parallel threads, and the tree is then
joined from the bottom up. Around each join a window is encoded again. It grows until both of its ends agree exactly
with what stands beside them:

- an end agrees where it lies at the edge of what is joined, or between two characters that no match of the
  pre-tokenizer's pattern can span, whatever came before (a letter and a space, a digit and a letter, ...);
- inside a longer run of one character class an end agrees where two whole tokens of the window are the neighbour's own
  tokens at the same place. A token sequence is a piece's encoding exactly if every two neighbours in it are, so
  shared tokens carry the agreement over.

So the result is that of encoding the whole text at once, which costs quadratic time in an unsplit run. Leaves are encoded
by tiktoken with the ranks and the pattern of the tokenizer's own file, which gives the ids of the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAF = 1 << 14
FIRST_WINDOW = 64
SHARED = 2
#: The pattern of byte-level pre-tokenizers of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def char_class(c: str) -> str:
    import unicodedata

    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return "s"
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "o"


def always_splits(a: str, b: str) -> bool:
    """Whether no match of PATTERN can hold a followed by b."""
    ka, kb = char_class(a), char_class(b)
    return ka != "s" and ka != kb and not (a == "'" and kb == "L")


class TreeBpe:
    def __init__(self, path: str | None = None, leaf: int = LEAF, threads: int = 2):
        import tiktoken

        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(symbol[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.threads = leaf, threads
        self.pieces: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.pieces[i] = t
        self.size = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())

    def _unspecial(self, text: str) -> list[str | int]:
        """Parts of ordinary text and ids of special tokens, in order."""
        parts: list[str | int] = [text]
        for s, i in self.special.items():
            cut = []
            for p in parts:
                if isinstance(p, str) and s in p:
                    for k, x in enumerate(p.split(s)):
                        cut += [i, x] if k else [x]
                else:
                    cut.append(p)
            parts = cut
        return parts

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for p in self._unspecial(text or ""):
            if isinstance(p, int):
                out.append(np.array([p], dtype=np.uint32))
            elif p:
                out.append(self.encode_plain(p))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def encode_plain(self, text: str) -> np.ndarray:
        """As encode, with the special tokens' strings read as ordinary text."""
        return self._plain(text) if len(text) <= self.leaf else self._tree(text)

    def _tree(self, text: str) -> np.ndarray:
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.threads) as pool:
            level = [(a, b, ids) for (a, b), ids in zip(zip(cuts, cuts[1:], strict=False), pool.map(self._plain, leaves), strict=True)]
        while len(level) > 1:
            joined = [self._join(text, x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
            level = joined + ([level[-1]] if len(level) % 2 else [])
        return level[0][2]

    def _join(self, text: str, x: tuple, y: tuple) -> tuple:
        (lo, mid, left), (_, hi, right) = x, y
        before = text[max(lo, mid - 1) : mid]
        if before and mid < hi and always_splits(before, text[mid]):
            return lo, hi, np.concatenate([left, right])
        left_end, right_start = self._starts(left), self._starts(right)
        left_bytes, right_bytes = int(left_end[-1]), int(right_start[-1])
        grow = FIRST_WINDOW
        while True:
            a, a_sure = self._edge(text, mid, max(lo, mid - grow), lo, -1)
            b, b_sure = self._edge(text, mid, min(hi, mid + grow), hi, 1)
            keep = self._at(left_end, left_bytes - len(text[a:mid].encode()))
            drop = self._at(right_start, len(text[mid:b].encode()))
            if keep is not None and drop is not None:
                window = self._plain(text[a:b])
                same_left = a_sure or (len(window) >= SHARED and np.array_equal(window[:SHARED], left[keep : keep + SHARED]) and self._one_class(text, a, mid))
                same_right = b_sure or (drop >= SHARED and np.array_equal(window[-SHARED:], right[drop - SHARED : drop]) and self._one_class(text, mid, b))
                if same_left and same_right:
                    return lo, hi, np.concatenate([left[:keep], window, right[drop:]])
            if a == lo and b == hi:
                return lo, hi, self._plain(text[lo:hi])
            grow *= 2

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    @staticmethod
    def _at(starts: np.ndarray, byte: int) -> int | None:
        k = int(np.searchsorted(starts, byte))
        return k if k < len(starts) and starts[k] == byte else None

    @staticmethod
    def _edge(text: str, mid: int, far: int, limit: int, step: int) -> tuple[int, bool]:
        """The place nearest to mid, as far as far, where the text always splits; else far, which is sure at the limit only."""
        p = mid + (step > 0)
        while min(far, mid) <= p <= max(far, mid) and p != limit and 0 < p < len(text):
            if always_splits(text[p - 1], text[p]):
                return p, True
            p += step
        return far, far == limit

    @staticmethod
    def _one_class(text: str, a: int, b: int) -> bool:
        return len({char_class(c) for c in text[max(0, a - 1) : b + 1]}) == 1

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def _worker(path: str | None, leaf: int, threads: int) -> TreeBpe:
    return TreeBpe(path, leaf, threads)


def encoded(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF, threads: int = 2, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with_ids adds the token ids and the decoded text, keep further columns.

    path names the tokenizer's file on each machine (None: the installed default). Defined results: a null text is an
    empty one; strings of special tokens in a text become those tokens, as in the tokenizers library; repeated rows
    repeat; an empty table gives an empty result; null ids and other columns make no difference.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _worker(path, leaf, threads)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids = bpe.encode(t)
                back = bpe.decode(ids)
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()]
                rows.append(row + ([ids.astype(np.int32), back] if with_ids else []))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            for c in keep:
                out[c] = batch[f"kept_{c}"].to_numpy()
            yield out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep]).mapInPandas(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
