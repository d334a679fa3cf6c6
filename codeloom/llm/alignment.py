"""Operator 11, cross-tokenizer alignment through a dictionary of groups.

Two tokenizers cut the same bytes. The places where a token of both ends cut a text into groups of A ids and B ids. Texts share
most of their groups, so each distinct group is interned once and its links are expanded once:

1. tasks tokenise blocks of texts; a block is one row, with its own dictionary of groups and, for each text, the groups' numbers
   and frequencies;
2. the blocks' dictionaries are added up by group; links are expanded once for each distinct group, and the counts of id pairs are
   sums of links times the group's frequency;
3. each group's links, best links and count sum join back by group key, return to their block, and a text's figures are sums over
   its own groups.

Which tokens of a group are linked is a parameter: ``end`` links two tokens whose byte ranges end together, which is one link a
group (its last tokens); ``overlap`` links all tokens that share a byte.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TreeBpe
from .common import table, written

#: Bytes of text after which a block is closed; it bounds a block's dictionary, not a text: a longer text is a block of its own.
BLOCK_BYTES = 1 << 23
RULES = ("end", "overlap")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _joined(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(pieces), dtype=np.uint8)


def _ids(found: list[int] | np.ndarray) -> np.ndarray:
    return np.frombuffer(array("i", found), dtype=np.int32) if isinstance(found, list) else found.astype(np.int32)


def _spell(raw: np.ndarray, ids: np.ndarray, pieces: np.ndarray, start: np.ndarray, size: np.ndarray) -> bool:
    """Whether the ids' bytes, which stand in pieces, joined are raw."""
    long = size[ids]
    end = np.cumsum(long)
    if not len(ids) or end[-1] != len(raw):
        return False
    at = np.repeat(start[ids] - end + long, long)
    at += np.arange(len(raw))
    return bool(np.array_equal(pieces[at], raw))


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import sentencepiece

        known = default_paths() if path_a is None or path_b is None else (path_a, path_b)
        self.a = TreeBpe(path_a or known[0])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or known[1])
        self.bytes_a = self.a.pieces
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a = np.array([len(p) for p in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(p) for p in self.bytes_b], dtype=np.int64)
        self.all_a, self.all_b = _joined(self.bytes_a), _joined(self.bytes_b)
        self.start_a, self.start_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The A ids of a space and the text, and the B ids of the text; none where either does not spell these bytes."""
        none = np.zeros(0, dtype=np.int32)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                yield none, none
                continue
            raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            # a short text's ids come faster as a list than through the encoder's own buffer
            a = self.a.bpe.encode_ordinary(" " + text) if len(text) < self.a.leaf else self.a.encode_plain(" " + text)
            a, b = _ids(a), _ids(b)
            same = _spell(raw, a, self.all_a, self.start_a, self.size_a) and _spell(raw, b, self.all_b, self.start_b, self.size_b)
            yield (a, b) if same else (none, none)

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many A and B tokens lie before each place where one of both ends, the start included."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)
        both = np.flatnonzero(ends_b[at] == ends_a) if len(a) else np.zeros(0, dtype=np.int64)
        return np.concatenate([[0], both + 1]), np.concatenate([[0], at[both] + 1])

    def links(self, a: list[int], b: list[int], rule: str) -> list[tuple[int, int]]:
        """The linked id pairs of one group, as often as their tokens are linked."""
        if rule == "end":
            return [(a[-1], b[-1])]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        first = np.searchsorted(ends_b, ends_a - self.size_a[a], "right")
        last = np.searchsorted(ends_b, ends_a, "left")
        return [(x, b[k]) for x, i, j in zip(a, first.tolist(), last.tolist(), strict=True) for k in range(i, j + 1)]


@cache
def _worker(path_a: str | None, path_b: str | None) -> Pair:
    return Pair(path_a, path_b)


class _Dictionary(dict):
    """Numbers keys in the order of their first use, and lists their names. Numbers of keys that are numbers are also looked up by the array."""

    SLOTS = 1 << 18

    def __init__(self):
        self.names: list[str] = []
        self.held, self.number = np.full(self.SLOTS, -1, dtype=np.int64), np.zeros(self.SLOTS, dtype=np.int32)

    def __missing__(self, key):
        self[key] = n = len(self)
        self.names.append(_name(key))
        return n

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of many keys. A slot holds one of the keys that fall on it; the dictionary itself answers for the others."""
        slot = (codes ^ (codes >> 32) * 40503) & (self.SLOTS - 1)
        out = self.number[slot]
        for k in np.flatnonzero(self.held[slot] != codes).tolist():
            code = int(codes[k])
            out[k] = self.number[slot[k]] = self[code]
            self.held[slot[k]] = code
        return out


def _name(key: bytes | int) -> str:
    if isinstance(key, int):
        return f"{key >> 32}|{key & 0xFFFFFFFF}"
    n = int.from_bytes(key[:4], "little")
    ids = np.frombuffer(key, "<u4", offset=4).tolist()
    return ",".join(map(str, ids[:n])) + "|" + ",".join(map(str, ids[n:]))


def _grouped(pair: Pair, texts: list[str]) -> dict[str, list]:
    """One block: a dictionary of its groups with frequencies, and each text's figures, groups and their frequencies."""
    known = _Dictionary()
    out: dict[str, list] = {"n_a": [], "n_b": [], "n_groups": [], "groups_sha256": []}
    runs, locals_, times = [0], [], []
    for a, b in pair.encode(texts):
        cut_a, cut_b = pair.cuts(a, b)
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        single = (n_a == 1) & (n_b == 1)
        # a group of one token each is keyed by a number, any other by its ids
        at = np.empty(len(n_a), dtype=np.int32)
        at[single] = known.numbers(a[cut_a[:-1][single]].astype(np.int64) << 32 | b[cut_b[:-1][single]])
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        more = np.flatnonzero(~single)
        places = (n_a[more], 4 * cut_a[more], 4 * cut_a[more + 1], 4 * cut_b[more], 4 * cut_b[more + 1])
        at[more] = [known[n.to_bytes(4, "little") + raw_a[i:j] + raw_b[u:v]] for n, i, j, u, v in zip(*(x.tolist() for x in places), strict=True)]
        used, n = np.unique(at, return_counts=True)
        locals_.append(used)
        times.append(n)
        runs.append(runs[-1] + len(used))
        said = hashlib.sha256(";".join(map(known.names.__getitem__, at.tolist())).encode()).hexdigest() if len(at) else ""
        for column, x in zip(out, (len(a), len(b), len(at), said), strict=True):
            out[column].append(x)
    locals_, times = np.concatenate(locals_), np.concatenate(times)
    freq = np.bincount(locals_, weights=times, minlength=len(known)).astype(np.int64)
    return out | {"keys": known.names, "freq": freq, "runs": runs, "locals": locals_, "times": times}


def blocks_of(docs: DataFrame, path_a: str | None, path_b: str | None, block_bytes: int) -> DataFrame:
    """One row a block of texts; docs has the columns doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, keys array<string>, freq array<bigint>, runs array<bigint>, locals array<int>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = _worker(path_a, path_b)
        number = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list = []
        texts: list[str] = []
        size = 0

        def block() -> pa.RecordBatch:
            row = {"block": next(number), "doc_id": ids} | _grouped(pair, texts)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                of = {"block": pa.int64(), "doc_id": pa.list_(batch.schema.field("doc_id").type), "groups_sha256": pa.list_(pa.string()), "keys": pa.list_(pa.string()), "locals": pa.list_(pa.int32())}
                arrow = pa.schema([(c.split()[0], of.get(c.split()[0], pa.list_(pa.int64()))) for c in schema.split(", ")])
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(t or "") > block_bytes:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
        if texts:
            yield block()

    return docs.mapInArrow(run, schema)


def linked(groups: DataFrame, path_a: str | None, path_b: str | None, rule: str) -> DataFrame:
    """key, a, b, n, freq: the links of each distinct group, n of the same id pair in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker(path_a, path_b)
        for batch in batches:
            rows = []
            for key, freq in zip(batch.column("key").to_pylist(), batch.column("freq").to_pylist(), strict=True):
                a, b = ([*map(int, side.split(","))] for side in key.split("|"))
                many: dict[tuple[int, int], int] = {}
                for x in pair.links(a, b, rule):
                    many[x] = many.get(x, 0) + 1
                rows += [(key, x, y, n, freq) for (x, y), n in many.items()]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["key", "a", "b", "n", "freq"])

    return groups.mapInArrow(run, "key string, a int, b int, n bigint, freq bigint")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of all texts hold an id pair, and whether no pair of its B id has more."""
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("freq")).alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))


def aligned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, rule: str = "end", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    path_a and path_b name the tokenizers' files on each machine (None: the installed defaults). Under the rule ``end`` a group has
    one link, so n_links equals n_groups. Defined results: a null or empty text, and one that either tokenizer does not give back byte
    for byte, has zeros and an empty digest, and adds nothing to the counts; repeated rows repeat and count each; null ids and other
    columns make no difference; of ids with equal counts each is best; a text is tokenised whole within one task, however long; an empty
    table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = written(blocks_of(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path_a, path_b, block_bytes), "alignment-blocks")
    uses = blocks.select("block", F.posexplode(F.arrays_zip("keys", "freq")).alias("local", "g")).select("block", "local", F.col("g.keys").alias("key"), F.col("g.freq").alias("freq"))
    groups = uses.groupBy("key").agg(F.sum("freq").alias("freq"))
    links = written(linked(groups, path_a, path_b, rule), "alignment-links")
    scored = links.join(pair_counts(links), ["a", "b"])
    values = scored.groupBy("key").agg(F.sum("n").alias("n_links"), F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    back = uses.join(values, "key").select(F.col("block").alias("of"), "local", "n_links", "n_best", "count_sum")
    out = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "runs", "locals", "times").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, out)


def _summed(block: pa.Table, values: pa.Table) -> pa.Table:
    """The figures of a block's texts from those of its groups."""
    row = {c: block.column(c).combine_chunks() for c in block.column_names}
    flat = {c: x.flatten() for c, x in row.items() if c != "block"}
    order = np.argsort(values.column("local").to_numpy())
    runs, at, times = flat["runs"].to_numpy(), flat["locals"].to_numpy(), flat["times"].to_numpy()
    sums = {}
    for c in ("n_links", "n_best", "count_sum"):
        known = values.column(c).to_numpy()[order]
        total = np.concatenate([[0], np.cumsum(known[at] * times)]) if len(at) else np.zeros(1, dtype=np.int64)
        sums[c] = pa.array(total[runs[1:]] - total[runs[:-1]], type=pa.int64())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([sums.get(c, flat.get(c)) for c in names], names=names)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
