"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A sequence of symbols is the leaf row of a tree: leaf i holds rank * width + i for the
pair that starts at symbol i, every inner node the least of its two children.  The root
is then the leftmost pair of the lowest rank.  A merge changes three leaves, each
updated on its path to the root.  Many short words share one array of equal trees
(one row each), so that a step merges the root pair of every unfinished word at once;
a long word has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: The split pattern of byte-level BPE, with white space as Unicode defines it.
WS = r"\p{White_Space}"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|{WS}+(?![^{WS}])|{WS}+")
#: Text cut where no pretoken crosses: a run without white space and the blank before it, or white space.
UNIT = regex.compile(rf" ?[^{WS}]+|{WS}+(?![^{WS}])|{WS}+")
#: Units longer than this aren't kept; more units than that aren't held at once.
KEEP_CHARS, KEEP_UNITS = 64, 250_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 as itself, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary with merge ranks, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters, suffix = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
        back = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * self.size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word.removesuffix(suffix)) + b" " * (suffix != "" and word.endswith(suffix))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # Ranks of pairs of bytes inside a word, and of those that end it.
        every = np.arange(256)
        self.inner = self.rank(self.first[every][:, None], self.first[every][None, :]).ravel()
        self.ending = self.rank(self.first[every][:, None], self.last[every][None, :]).ravel()
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kept: dict[str, bytes] = {}  # units and their ids, as of late
        self.older: dict[str, bytes] = {}  # those before; what is met again moves back

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they don't merge or a symbol is missing (-1)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, with one segment tree for each, all of the same width."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        width = 1 << max(1, (int(lengths.max()) - 1).bit_length())
        places = np.arange(width, dtype=np.int64)
        mask = places < lengths[:, None]
        data = np.zeros((n, width + 1), np.int64)
        data[:, :width][mask] = np.frombuffer(b"".join(words), np.uint8)
        every, ends = np.arange(n), lengths - 1
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width][mask] = self.first[data[:, :width][mask]]
        symbol[every, ends] = self.last[data[every, ends]]
        after = np.where(places + 1 < lengths[:, None], places + 1, width)  # the next living symbol; width: none
        before = np.broadcast_to(places - 1, (n, width)).copy()
        pair = data[:, :width] * 256 + data[:, 1:]
        ranks = self.inner[pair]
        ranks[every, ends - 1] = self.ending[pair[every, ends - 1]]
        ranks[places >= ends[:, None]] = NONE
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks * width + places)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            next_ = np.where(gone < width, after[live, np.minimum(gone, width - 1)], width)
            symbol[live, at] = self.merged[rank]
            symbol[live, gone] = -1
            after[live, at] = next_
            has = next_ < width
            before[live[has], next_[has]] = at[has]
            previous = before[live, at]
            self.point(tree, width, live, gone, np.full(len(live), NONE))
            right = self.rank(symbol[live, at], np.where(has, symbol[live, next_], -1))
            self.point(tree, width, live, at, np.where(right == NONE, NONE, right * width + at))
            has = previous >= 0
            rows, p = live[has], previous[has]
            left = self.rank(symbol[rows, p], symbol[rows, at[has]])
            self.point(tree, width, rows, p, np.where(left == NONE, NONE, left * width + p))
            live = live[tree[live, 1] != NONE]
        left = symbol[:, :width] >= 0
        flat, ends = symbol[:, :width][left].astype("<u4").tobytes(), (left.sum(1).cumsum() * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def point(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Set one leaf of each of the trees in rows, and the nodes above it."""
        node = leaf + width
        tree[rows, node] = value
        node = node >> 1
        while len(node) and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long word, with lists instead of arrays: a few logarithmic updates for each merge."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        symbol = [*self.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        ranks = self.rank(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        leaves = np.full(width, NONE, np.int64)
        leaves[: n - 1] = np.where(ranks == NONE, NONE, ranks * width + np.arange(n - 1))
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        of = self.pairs()

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != NONE:
            at, rank = tree[1] % width, tree[1] // width
            gone = after[at]
            symbol[at], symbol[gone] = int(self.merged[rank]), -1
            put(gone, NONE)
            nxt = after[at] = after[gone]
            if nxt >= 0:
                before[nxt] = at
            r = of.get(symbol[at] * self.size + symbol[nxt]) if nxt >= 0 else None
            put(at, NONE if r is None else r * width + at)
            if (p := before[at]) >= 0:
                r = of.get(symbol[p] * self.size + symbol[at])
                put(p, NONE if r is None else r * width + p)
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pairs

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of pretokens in their order: those of like width go through one array of trees."""
        done = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths == 1).tolist():
            done[i] = self.last[np.frombuffer(words[i], np.uint8)].astype("<u4").tobytes()
        for i in np.flatnonzero(lengths > 256).tolist():
            done[i] = self.merge_long(words[i])
        low = 1
        for width in (4, 8, 16, 32, 64, 128, 256):
            own = np.flatnonzero((lengths > low) & (lengths <= width)).tolist()
            low, step = width, 65536 // width
            for k in range(0, len(own), step):
                part = own[k : k + step]
                for i, ids in zip(part, self.merge_all([words[i] for i in part]), strict=True):
                    done[i] = ids
        return done

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of new units, as little-endian unsigned 32-bit numbers."""
        cut = [PRETOKEN.findall(u) for u in units]
        pieces = list({p for c in cut for p in c})
        ids = dict(zip(pieces, self.words([p.encode() for p in pieces]), strict=True))
        return {u: ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c)) for u, c in zip(units, cut, strict=True)}

    def parts(self, text: str) -> list[str | int]:
        """The text between special tokens, and the ids of those."""
        if not self.splits or not self.splits.search(text):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.splits.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        cut = [[UNIT.findall(p) if isinstance(p, str) else p for p in self.parts(t)] for t in texts]
        if len(self.kept) > KEEP_UNITS:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        new = {u for parts in cut for p in parts if not isinstance(p, int) for u in p}.difference(kept)
        for u in older.keys() & new if len(older) > len(new) else new & older.keys():
            kept[u] = older[u]
        got = self.learn(sorted(new.difference(kept)))
        kept.update(got)
        out = [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(kept.__getitem__, p)) for p in parts]) for parts in cut]
        for u in got:
            if len(u) > KEEP_CHARS:
                kept.pop(u, None)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, special tokens their own text."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded, for every row of docs.

    A null text is encoded as an empty one.  Special tokens in a text get their ids.  Repeated
    rows give repeated results.  Texts of any length are encoded whole.  Other columns are left
    out, an empty table gives no rows.  The vocabulary is read from path on each executor.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: bpe_documents without moving ids or texts back to the JVM."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(bpe.decode(i).encode("utf-8", "replace")).hexdigest() for i in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of all documents. See bpe_documents for odd rows."""
    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
